"""Files below roots: a listing that follows no symbolic link, guards of roots, and opening that can't leave a root."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annalist.functions.scalars import normalized_path

SCHEMA = "root_role string, path string, byte_length long, modified_ns long, changed_ns long, inode long, device long"


class UnhealthyRoot(Exception):
    """A root is no real directory, or its marker isn't the expected one. Nothing of such a scan may count, absences least."""


@dataclass(frozen=True)
class Root:
    role: str
    path: str
    marker: str | None = None  # a file below the root, and the SHA-256 that it must have
    marker_sha256: str | None = None


def open_beneath(root: str, path: str) -> int:
    """A descriptor of the file at path below root. No component may be a symbolic link, a dot, two dots or empty."""
    parts = path.split("/")
    if not all(parts) or {".", ".."} & set(parts) or "\x00" in path:
        raise ValueError(f"not a plain relative path: {path!r}")
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC)
    try:
        for n, part in enumerate(parts):
            last = n == len(parts) - 1
            below = os.open(part, os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC | (0 if last else os.O_DIRECTORY), dir_fd=at)
            os.close(at)
            at = below
    except BaseException:
        with suppress(OSError):
            os.close(at)
        raise
    return at


def check_roots(roots: list[Root]) -> None:
    """Raise UnhealthyRoot unless every root is a real directory with its marker. For before a scan, and after it."""
    for r in roots:
        try:
            mode = os.lstat(r.path).st_mode
            if not stat.S_ISDIR(mode):
                raise UnhealthyRoot(f"{r.role}: the root is not a real directory")
            if r.marker is not None:
                with os.fdopen(open_beneath(r.path, r.marker), "rb") as f:
                    if hashlib.file_digest(f, "sha256").hexdigest() != r.marker_sha256:
                        raise UnhealthyRoot(f"{r.role}: the marker is not the expected one")
        except OSError as e:
            raise UnhealthyRoot(f"{r.role}: {e}") from e


@dataclass
class _Part(InputPartition):
    role: str
    root: str
    top: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.role, self.root = options.get("role", ""), options["path"]

    def partitions(self) -> list[InputPartition]:
        """One for each directory in the root, and one for the files that lie in it."""
        with os.scandir(self.root) as entries:
            tops = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
        return [_Part(self.role, self.root, "", False), *(_Part(self.role, self.root, t, True) for t in tops)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.top]
        while todo:
            folder = todo.pop()
            with os.scandir(os.path.join(partition.root, folder)) as entries:
                for e in entries:
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep:
                            todo.append(path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield partition.role, path, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, s.st_dev


class DirectorySource(DataSource):
    """``spark.read.format("directory").option("role", ...).load(path)``: a row for each regular file below path, at any depth."""

    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listed(spark: SparkSession, roots: list[Root]) -> DataFrame:
    """The files of all roots; the roots are checked first. Call ``check_roots`` again once the listing has been read."""
    check_roots(roots)
    spark.dataSource.register(DirectorySource)
    out = None
    for r in roots:
        one = spark.read.format("directory").option("role", r.role).load(r.path)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def allowlist(paths: DataFrame) -> DataFrame:
    """The normal forms of paths (path), which must be some, all proper, and no two the same."""
    p = paths.select("path", normalized_path(F.col("path")).alias("normal"))
    bad = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("normal").isNull()).alias("improper")).first()
    twice = p.groupBy("normal").count().where("count > 1").limit(1).collect()
    if not bad.n or bad.improper or twice:
        raise ValueError("an allowlist must not be empty" if not bad.n else "an allowlist has improper paths" if bad.improper else f"twice in an allowlist: {twice[0].normal!r}")
    return p.select(F.col("normal").alias("path"))
