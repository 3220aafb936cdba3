"""Scalar rules as Columns: identifiers, paths, names, backoff, outcomes and enums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_STATES = ("active", "tombstoned")
EVENT_KINDS = ("revision_committed", "location_changed", "record_tombstoned", "record_restored")
DELIVERY_STATES = ("queued", "leased", "acknowledged", "ignored_by_policy", "superseded", "blocked", "dead_lettered")
#: Deliveries in these states let later versions of the record pass.
RELEASING = ("acknowledged", "ignored_by_policy", "superseded")
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_BLANK = r"[\s\u0085   -     　]"


def valid_identifier(c: Column) -> Column:
    """Neither empty nor with white space (of Unicode) at an end, and without NUL; null is not valid."""
    return F.coalesce((c != "") & ~c.rlike(f"^{_BLANK}|{_BLANK}\\z") & (F.instr(c, "\x00") == 0), F.lit(False))


def valid_root_role(c: Column) -> Column:
    return valid_identifier(c) & (F.instr(c, "/") == 0) & (F.instr(c, "\\") == 0)


def valid_path(c: Column) -> Column:
    """Relative, without NUL, and no component, cut at either slash, is empty, one dot or two dots."""
    parts = F.split(c, r"[/\\]")
    return F.coalesce((c != "") & (F.instr(c, "\x00") == 0) & ~F.exists(parts, lambda x: x.isin("", ".", "..")), F.lit(False))


def normalized_path(c: Column) -> Column:
    """Components joined by a slash; empty ones and inner single dots vanish; null for an absolute path, or one that begins
    with a dot as a component, or has two dots."""
    parts = F.split(c, "/")
    kept = F.filter(parts, lambda x: ~x.isin("", "."))
    return F.when(~c.startswith("/") & (parts[0] != ".") & ~F.array_contains(parts, "..") & (F.size(kept) > 0), F.array_join(kept, "/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_candidate_name(path: Column, prefix: str = "rollout-", suffix: str = ".jsonl") -> Column:
    n = file_name(path)
    return n.startswith(prefix) & n.endswith(suffix)


def filename_session(path: Column, prefix: str = "rollout-", suffix: str = ".jsonl") -> Column:
    """A struct of status (skip, error, ok) and the uuid that ends a candidate's stem."""
    stem = F.regexp_replace(file_name(path), f"{suffix.replace('.', chr(92) + '.')}$", "")
    tail = F.right(stem, F.lit(36))
    short = ~is_candidate_name(path, prefix, suffix) | (F.length(stem) <= 36)
    dash = F.substring(stem, F.length(stem) - 36, F.lit(1)) == "-"
    status = F.when(F.coalesce(short, F.lit(True)) | ~dash, "skip").when(tail.rlike(UUID), "ok").otherwise("error")
    return F.struct(status.alias("status"), F.when(status == "ok", F.lower(tail)).alias("session"))


def header_session(text: Column, limit: int = 65_536) -> Column:
    """The session id in the first line's JSON header, or null if the line is no such header or too long."""
    line = F.substring_index(text, "\n", 1)
    kind, id_ = F.get_json_object(line, "$.type"), F.get_json_object(line, "$.payload.id")
    return F.when((F.octet_length(line) <= limit) & (kind == "session_meta") & id_.rlike(UUID), F.lower(id_))


def revision_key(text: Column) -> Column:
    """byte_length and digest of a whole record; the digest is SHA-256."""
    return F.struct(F.octet_length(text).cast("long").alias("byte_length"), F.sha2(text.cast("binary"), 256).alias("digest"))


def digest_bytes(hex_: Column) -> Column:
    """The 32 bytes of a digest of exactly 64 hexadecimal signs, else null."""
    return F.when(hex_.rlike("^[0-9a-fA-F]{64}$"), F.unhex(hex_))


def time_parts(ms: Column) -> Column:
    """Whole seconds, rounded down, and nanoseconds from 0 on, of epoch milliseconds."""
    return F.struct(F.floor(ms / 1000).cast("long").alias("seconds"), (F.pmod(ms, F.lit(1000)) * 1_000_000).cast("long").alias("nanos"))


def initial_state(kind: Column, moves: Column, tombstones: Column) -> Column:
    refused = ((kind == "location_changed") & ~moves) | ((kind == "record_tombstoned") & ~tombstones)
    return F.when(refused, "blocked").otherwise("queued")


def backoff(now: Column, attempt: Column, first: Column, most: Column) -> Column:
    """now + min(most, first * 2^min(attempt - 1, 63)), without overflow."""
    doubled = first.cast("double") * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(63)).cast("double"))
    return now + F.when(doubled >= most.cast("double"), most).otherwise(doubled.cast("long"))


def outcome_state(outcome: Column) -> Column:
    names = {"acknowledged": "acknowledged", "ignored_by_policy": "ignored_by_policy", "superseded": "superseded", "dead_letter": "dead_lettered"}
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[outcome]


def advances(outcome: Column) -> Column:
    return outcome != "dead_letter"


def receipt_outcome(revision: Column) -> Column:
    return F.when(revision.isNotNull(), "acknowledged").otherwise("ignored_by_policy")


def source_ref(record: Column) -> Column:
    return F.concat(F.lit("record:"), record.cast("string"))


def idempotency_key(subscription: Column, event: Column) -> Column:
    return F.concat_ws(":", subscription.cast("string"), event.cast("string"))


def throughput(n_bytes: Column, seconds: Column) -> Column:
    return F.when((n_bytes > 0) & (seconds > 0), n_bytes / seconds)


def owned_name(name: Column) -> Column:
    """A lease's file, or the hidden partial of one: the only names a cache may delete."""
    u = UUID.strip("^$").replace("a-fA-F", "a-f")
    return name.rlike(f"^(lease-[0-9a-f]{{64}}-{u}\\.payload|\\.lease-[0-9a-f]{{64}}-{u}\\.partial)$")
