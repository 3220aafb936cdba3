"""Whole files or none: atomic publishing, a folder's one owner, leased copies of payloads and their reclaim."""

from __future__ import annotations

import fcntl
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from .files import open_beneath

_OWNED = re.compile(r"lease-[0-9a-f]{64}-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.payload|\.lease-[0-9a-f]{64}-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.partial")


class StalePayload(Exception):
    """The bytes aren't those of the revision any more."""


def publish(path: str, content: bytes) -> None:
    """Write a file that appears whole or not at all, and survives a crash once this returns."""
    folder = os.path.dirname(path) or "."
    partial = os.path.join(folder, f".{os.path.basename(path)}.{uuid.uuid4().hex}.partial")
    try:
        with open(partial, "xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(partial, path)
    except BaseException:
        with suppress(OSError):
            os.unlink(partial)
        raise
    at = os.open(folder, os.O_RDONLY | os.O_DIRECTORY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


@contextmanager
def owned(folder: str) -> Iterator[None]:
    """Hold a folder alone; BlockingIOError if another holds it."""
    with open(os.path.join(folder, ".owner"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield


@contextmanager
def leased_copy(root: str, path: str, byte_length: int, sha256: str, folder: str) -> Iterator[str]:
    """A read-only copy of a revision in folder, verified while it is copied, for as long as the block runs."""
    name = f"lease-{sha256}-{uuid.uuid4()}"
    partial, final = os.path.join(folder, f".{name}.partial"), os.path.join(folder, f"{name}.payload")
    try:
        digest, n = hashlib.sha256(), 0
        with os.fdopen(open_beneath(root, path), "rb") as f, open(partial, "xb") as out:
            while chunk := f.read(128 << 10):
                digest.update(chunk)
                n += len(chunk)
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        if (n, digest.hexdigest()) != (byte_length, sha256):
            raise StalePayload(path)
        os.chmod(partial, 0o400)
        os.rename(partial, final)
        yield final
    finally:
        for x in (partial, final):
            with suppress(FileNotFoundError):
                os.unlink(x)


def reclaim(folder: str) -> list[str]:
    """Delete what leases of a run that died left in a folder, and nothing else; the caller owns the folder."""
    gone = sorted(n for n in os.listdir(folder) if _OWNED.fullmatch(n) and os.path.isfile(os.path.join(folder, n)) and not os.path.islink(os.path.join(folder, n)))
    for n in gone:
        os.unlink(os.path.join(folder, n))
    return gone
