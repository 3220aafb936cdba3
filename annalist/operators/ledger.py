"""The ledger of change events, and what is derived from it, as window functions over observations.

Observations have record, o (their order), ms, present, rev and root. The state after an observation is the observation, so
each needs only its record's earlier rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.ordering import global_number


def changes(observations: DataFrame) -> DataFrame:
    """record, o, sub, kind, rev, root and ms of each change; one shuffle by record."""
    w = W.partitionBy("record").orderBy("o")
    seen = lambda c: F.last(F.when(F.col("present"), F.col(c)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = observations.withColumns({"was": F.lag("present").over(w), "prev_rev": seen("rev"), "prev_root": seen("root")})
    here, was = F.col("present"), F.coalesce("was", F.lit(False))

    def event(cond, sub: int, kind: str, rev: str, root: str):
        return F.when(cond, F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), F.col(rev).alias("rev"), F.col(root).alias("root")))

    same = F.col("prev_rev").isNotNull() & (F.col("prev_rev") == F.col("rev"))
    found = F.array(
        event(~here & was, 0, "record_tombstoned", "prev_rev", "prev_root"),
        event(here & ~was & F.col("prev_rev").isNotNull(), 0, "record_restored", "prev_rev", "root"),
        event(here & ~same, 1, "revision_committed", "rev", "root"),
        event(here & was & same & (F.col("prev_root") != F.col("root")), 1, "location_changed", "rev", "root"),
    )
    return d.select("record", "o", "ms", F.explode(F.array_compact(found)).alias("e")).select("record", "o", "e.sub", "e.kind", "e.rev", "e.root", "ms")


def ledger(observations: DataFrame) -> DataFrame:
    """sequence (gapless over all), record, record_version (gapless in the record), kind, rev, root and ms."""
    c = changes(observations).withColumn("record_version", F.row_number().over(W.partitionBy("record").orderBy("o", "sub")).cast("long"))
    return global_number(c, "o", ["sub"], "sequence").select("sequence", "record", "record_version", "kind", "rev", "root", "ms")


def current(events: DataFrame) -> DataFrame:
    """The state of each record: that of its last event. Reduced before the shuffle."""
    top = events.groupBy("record").agg(F.max_by(F.struct("kind", "rev", "root", "record_version", "ms"), "record_version").alias("e"), F.min("ms").alias("created_ms"))
    state = F.when(F.col("e.kind") == "record_tombstoned", "tombstoned").otherwise("active")
    return top.select("record", state.alias("state"), "e.rev", "e.root", "e.record_version", "created_ms", F.col("e.ms").alias("updated_ms"))


def revisions(observations: DataFrame) -> DataFrame:
    return observations.where("present").groupBy("record", "rev").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def stability(scans: DataFrame, completed: DataFrame) -> DataFrame:
    """scans (record, gen, fp) with unchanged, the observations in a row with one fingerprint.

    A run breaks where the fingerprint changes, or where a completed generation lies between two observations. completed
    (gen) has a row for a generation and its number among completed ones is joined by range of one value, so no pairs arise.
    """
    c = completed.select("gen", F.row_number().over(W.orderBy("gen")).alias("nth"))
    upto = F.coalesce(F.max("nth").over(W.orderBy("gen")), F.lit(0))
    done = scans.select("gen").distinct().join(c, "gen", "left").select("gen", upto.alias("upto"), F.col("nth").isNotNull().cast("int").alias("own"))
    w = W.partitionBy("record").orderBy("gen")
    d = scans.join(done, "gen")
    gap = (F.col("upto") - F.col("own")) - F.lag("upto").over(w) > 0
    broke = F.coalesce((F.lag("fp").over(w) != F.col("fp")) | gap, F.lit(True))
    d = d.withColumn("island", F.sum(broke.cast("int")).over(w))
    return d.select("record", "gen", "fp", F.row_number().over(W.partitionBy("record", "island").orderBy("gen")).alias("unchanged"))


def reconcile(scans: DataFrame, completed: DataFrame, min_unchanged: int, max_bytes: int) -> DataFrame:
    """record, gen, fp and outcome of each candidate (scans: record, gen, fp, bytes), in the order in which a scan tests it.

    A candidate waits until its fingerprint was seen min_unchanged times in a row; one that is too large is deferred each
    time; of the others the first that is stable is hashed, and the run's later ones are stable already.
    """
    d = stability(scans.select("record", "gen", "fp"), completed).join(scans.select("record", "gen", "bytes"), ["record", "gen"])
    outcome = F.when(F.col("unchanged") < min_unchanged, "awaiting_stability").when(F.coalesce("bytes", F.lit(0)) > max_bytes, "deferred_by_size_limit").when(F.col("unchanged") > min_unchanged, "already_stable").otherwise("hashed")
    return d.select("record", "gen", "fp", outcome.alias("outcome"))


def committed(outcomes: DataFrame) -> DataFrame:
    """record, gen and fp of what was hashed and isn't what the record's last hash was."""
    last = F.lag("fp").over(W.partitionBy("record").orderBy("gen"))
    return outcomes.where("outcome = 'hashed'").withColumn("_last", last).where("_last is null or _last <> fp").select("record", "gen", "fp")


def tombstones(seen: DataFrame, generations: DataFrame, scans: int, grace_ms: int) -> DataFrame:
    """record, gen and ms where a record that is missing becomes a tombstone.

    generations has gen, ms and counts (complete and guarded); seen has record and gen. A record last seen in ls falls at the
    first later counting generation that is the scans-th or later since and at least grace_ms after the first. Generations are
    numbered, so each absence finds its own by a join on the number, not by enumerating absences.
    """
    g = generations.withColumn("nth", F.sum(F.col("counts").cast("int")).over(W.orderBy("gen")))
    s = seen.distinct().withColumn("next", F.lead("gen").over(W.partitionBy("record").orderBy("gen")))
    s = s.join(g.select("gen", F.col("nth").alias("at")), "gen")
    c = g.where("counts").select(F.col("gen").alias("cgen"), F.col("ms").alias("cms"), "nth")
    first = c.select((F.col("nth") - 1).alias("at"), F.col("cms").alias("first_ms"))
    # for each starting number, the least number that satisfies both conditions
    reach = c.alias("c").join(first.alias("f"), F.expr(f"c.nth >= f.at + {scans} and c.cms - f.first_ms >= {grace_ms}"))
    reach = reach.groupBy("f.at").agg(F.min(F.struct("c.cgen", "c.cms")).alias("m")).select("at", "m.cgen", "m.cms")
    return s.join(reach, "at").where("next is null or cgen < next").select("record", F.col("cgen").alias("gen"), F.col("cms").alias("ms"))
