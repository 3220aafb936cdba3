"""Ordered delivery to independent subscriptions: fan-out, barriers, leases, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.scalars import DELIVERY_STATES, RELEASING, backoff, initial_state, outcome_state


def fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A delivery for each event and subscription, paused ones too. Subscriptions are few; an event is one row in, n out."""
    s = subscriptions.agg(F.collect_list(F.struct("sub", "moves", "tombstones")).alias("subs"))
    e = events.join(F.broadcast(s)).withColumn("s", F.explode("subs"))
    return e.select(F.col("s.sub").alias("sub"), "sequence", "record", "record_version", "kind", "rev", "root", initial_state(F.col("kind"), F.col("s.moves"), F.col("s.tombstones")).alias("state"))


def replay(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("sequence") > after).select("sequence", "record", "record_version", "kind", "rev", "root")


def rebuild(current: DataFrame) -> DataFrame:
    """A synthetic row for each active record; it has no sequence."""
    return current.where("state = 'active'").select(F.lit(None).cast("long").alias("sequence"), "record", "record_version", F.lit("revision_committed").alias("kind"), "rev", "root")


def _unreleased():
    return ~F.col("state").isin(*RELEASING)


def barrier_anti(deliveries: DataFrame) -> DataFrame:
    """Deliveries without an unreleased earlier version of their record, by an anti join."""
    b = deliveries.where(_unreleased()).select(F.col("sub").alias("bs"), F.col("record").alias("br"), F.col("record_version").alias("bv"))
    return deliveries.join(b, F.expr("sub = bs and record = br and bv < record_version"), "left_anti")


def barrier_window(deliveries: DataFrame) -> DataFrame:
    """The same by one window: a delivery passes if no unreleased version of its record is smaller. One shuffle."""
    least = F.min(F.when(_unreleased(), F.col("record_version"))).over(W.partitionBy("sub", "record"))
    return deliveries.withColumn("_b", least).where("_b is null or _b >= record_version").drop("_b")


def expire(deliveries: DataFrame, subscriptions: DataFrame, now: int) -> DataFrame:
    """Leases that ended go back to the queue with backoff, or to the dead letters after the last attempt."""
    s = subscriptions.select("sub", "max_attempts", "first_ms", "most_ms")
    over = F.coalesce((F.col("state") == "leased") & (F.col("expires_ms") <= now), F.lit(False))
    dead = over & (F.col("attempts") >= F.col("max_attempts"))
    d = deliveries.join(F.broadcast(s), "sub")
    wait = backoff(F.lit(now), F.col("attempts"), F.col("first_ms"), F.col("most_ms"))
    return d.withColumns({
        "state": F.when(dead, "dead_lettered").when(over, "queued").otherwise(F.col("state")),
        "not_before_ms": F.when(over & ~dead, wait).otherwise(F.col("not_before_ms")),
        "expires_ms": F.when(~over, F.col("expires_ms")),
        "token": F.when(~over, F.col("token")),
        "settled_ms": F.when(dead, F.lit(now).cast("long")).when(~over, F.col("settled_ms")),
        "reason": F.when(dead, "retry policy exhausted after lease expiry").when(~over, F.col("reason")),
    }).select(*deliveries.columns)


def lease(deliveries: DataFrame, subscriptions: DataFrame, now: int, duration_ms: int) -> DataFrame:
    """The deliveries that a subscription's allowance is leased to now, in order; equal to leasing one after another."""
    d = expire(deliveries, subscriptions, now)
    ahead = F.min(F.when(_unreleased(), F.col("record_version"))).over(W.partitionBy("sub", "record"))
    most = subscriptions.agg(F.coalesce(F.max("max_leases"), F.lit(0))).first()[0]
    d = d.withColumn("_b", ahead).join(F.broadcast(_open(d, subscriptions)), "sub")
    ready = d.where(f"enabled and state = 'queued' and (not_before_ms is null or not_before_ms <= {now}) and _b = record_version")
    ready = _first(ready, most).where("nth <= max_leases - _active")
    return ready.select("sub", "nth", "sequence", "record", "record_version", "kind", "rev", (F.col("attempts") + 1).alias("attempts"), F.lit(now + duration_ms).cast("long").alias("expires_ms"), F.sha2(F.concat_ws(":", "sub", "sequence", F.col("attempts") + 1), 256).alias("token"))


def _open(d: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """sub, max_leases, enabled and _active, the leases that run: a row for each subscription."""
    n = d.groupBy("sub").agg(F.count(F.when(F.col("state") == "leased", 1)).alias("_active"))
    return subscriptions.select("sub", "max_leases", "enabled").join(n, "sub", "left").na.fill(0, ["_active"])


def _first(d: DataFrame, most: int) -> DataFrame:
    """The first most deliveries of each subscription, with their place nth; each task sends no more of one than that."""
    w = W.partitionBy("sub").orderBy(F.col("sequence").asc_nulls_last(), "record", "record_version")
    return d.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def compare_and_set(deliveries: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """requests (sub, sequence, token, ...) with valid: the delivery is leased, with this token, beyond now."""
    d = deliveries.select("sub", "sequence", F.col("state").alias("_s"), F.col("token").alias("_t"), F.col("expires_ms").alias("_e"))
    ok = F.coalesce((F.col("_s") == "leased") & (F.col("_t") == F.col("token")) & (F.col("_e") > now), F.lit(False))
    return requests.join(d, ["sub", "sequence"], "left").withColumn("valid", ok).drop("_s", "_t", "_e")


def _applied(deliveries: DataFrame, requests: DataFrame, now: int, keep: list[str]) -> DataFrame:
    r = requests.withColumnRenamed("token", "_t").select("sub", "sequence", "_t", *[F.col(k).alias(f"_{k}") for k in keep])
    d = deliveries.join(r, ["sub", "sequence"], "left")
    return d.withColumn("_ok", F.coalesce((F.col("state") == "leased") & (F.col("token") == F.col("_t")) & (F.col("expires_ms") > now), F.lit(False)))


def _released(d: DataFrame, changed: dict, columns: list[str]) -> DataFrame:
    ok = F.col("_ok")
    base = {c: F.when(ok, v).otherwise(F.col(c)) for c, v in changed.items()}
    gone = {c: F.when(ok, F.lit(None)).otherwise(F.col(c)) for c in ("token", "expires_ms")}
    return d.withColumns(base | gone).select(*columns)


def settle(deliveries: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """The deliveries after the valid requests (with outcome) are settled; the others are unchanged."""
    d = _applied(deliveries, requests, now, ["outcome", "reason"])
    return _released(d, {"state": outcome_state(F.col("_outcome")), "settled_ms": F.lit(now).cast("long"), "reason": F.col("_reason")}, deliveries.columns)


def retry(deliveries: DataFrame, requests: DataFrame, subscriptions: DataFrame, now: int) -> DataFrame:
    d = _applied(deliveries, requests, now, []).join(F.broadcast(subscriptions.select("sub", "max_attempts", "first_ms", "most_ms")), "sub")
    dead = F.col("attempts") >= F.col("max_attempts")
    wait = F.when(dead, F.col("not_before_ms")).otherwise(backoff(F.lit(now), F.col("attempts"), F.col("first_ms"), F.col("most_ms")))
    gone = {"settled_ms": F.when(dead, F.lit(now).cast("long")), "reason": F.when(dead, "retry policy exhausted")}
    return _released(d, {"state": F.when(dead, "dead_lettered").otherwise("queued"), "not_before_ms": wait} | gone, deliveries.columns)


def block(deliveries: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    d = _applied(deliveries, requests, now, ["reason"])
    return _released(d, {"state": F.lit("blocked"), "settled_ms": F.lit(None).cast("long"), "reason": F.col("_reason")}, deliveries.columns)


def counts(deliveries: DataFrame) -> DataFrame:
    """Deliveries of each subscription by state, a column for each state, 0 if there is none."""
    return deliveries.groupBy("sub").pivot("state", list(DELIVERY_STATES)).agg(F.count(F.lit(1))).na.fill(0)


def controlled_run(deliveries: DataFrame, subscriptions: DataFrame, sizes: DataFrame, now: int, most: int, budget: int, trouble: Column | None = None) -> DataFrame:
    """What a run takes that settles each delivery before it leases the next: sub, nth, sequence, bytes and outcome.

    A delivery can come up if all unreleased versions before it can, too. In order, up to most deliveries run, until one
    would overflow the budget of bytes, or has trouble: retried (its consumer fails, or its payload is gone and the policy
    is to retry) or blocked (gone, and the policy is to block); null is none. That one ends the run.
    """
    d = expire(deliveries, subscriptions, now)
    ready = (F.col("state") == "queued") & F.coalesce(F.col("not_before_ms") <= now, F.lit(True))
    stuck = F.min(F.when(_unreleased() & ~ready, F.col("record_version"))).over(W.partitionBy("sub", "record"))
    d = d.withColumns({"_ready": ready, "_stuck": stuck}).join(F.broadcast(_open(d, subscriptions)), "sub")
    d = d.where("enabled and _ready and _active < max_leases and (_stuck is null or _stuck > record_version)").join(sizes, "rev", "left")
    w = W.partitionBy("sub").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    d = _first(d.withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long")), most)
    bad = F.lit(None).cast("string") if trouble is None else trouble
    d = d.withColumn("_end", F.when(F.sum("bytes").over(w) > budget, "deferred_by_byte_budget").otherwise(bad))
    d = d.withColumn("_ends", F.count("_end").over(w))
    return d.where("_ends = 0 or (_ends = 1 and _end is not null)").select("sub", "nth", "sequence", "bytes", F.coalesce("_end", F.lit("settled")).alias("outcome"))
