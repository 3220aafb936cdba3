"""Catalog operators: scans, verification, status, budgets of caches, snapshots after a change. DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.ordering import folded
from annalist.functions.scalars import RELEASING

MANIFEST = "format_version int, created_at_ms long, schema_version int, latest_event_sequence long, configuration_digest string"


def enum_violations(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def parsed_manifest(text: Column) -> Column:
    """The manifest's fields, and valid: it parses, every field is there and its format version is 1."""
    m = F.from_json(text, MANIFEST)
    fields = [f.split()[0] for f in MANIFEST.split(", ")]
    whole = F.lit(True)
    for f in fields:
        whole = whole & m[f].isNotNull()
    return F.struct(*[m[f].alias(f) for f in fields], F.coalesce(whole & (m["format_version"] == 1), F.lit(False)).alias("valid"))


def allowed(every: DataFrame, allowlist: DataFrame) -> DataFrame:
    return every.join(allowlist, ["root", "path"], "left_semi")


def verified(payloads: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """key and intact: the content has the kept length and digest."""
    p = payloads.select(key, F.octet_length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_d"))
    return p.join(kept, key).select(key, F.coalesce((F.col("_n") == F.col("byte_length")) & (F.col("_d") == F.col("digest")), F.lit(False)).alias("intact"))


def scrub_progress(sources: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return sources.join(state, key, "left").select(key, F.coalesce("cycles", F.lit(0)).alias("cycles"), "cursor")


def conflicts(asked: DataFrame, kept: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What is asked for under a key that is kept with another value."""
    k = kept.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    other = F.lit(False)
    for c in columns:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return asked.join(k, key).where(other).select(*asked.columns)


def ownership_conflicts(owners: DataFrame) -> DataFrame:
    return owners.groupBy("record").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


def duplicates(found: DataFrame, keys: list[str], identity: str) -> DataFrame:
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(identity).alias("_d"))
    return n.where("n > _d").drop("_d")


def epoch_choice(n: Column) -> Column:
    return F.when(n == 0, "create").when(n == 1, "reuse").otherwise("refuse")


def catalog_counts(current: DataFrame, revisions: DataFrame, candidates: DataFrame) -> DataFrame:
    c = current.agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "tombstoned").alias("tombstoned"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return c.join(n(revisions, "revisions")).join(n(candidates, "candidates"))  # one row each


def source_status(state: DataFrame, records: DataFrame, observations: DataFrame, candidates: DataFrame, scrub: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias(name))
    out = state.select("source", (F.col("last_generation") + 1).alias("next_generation"), "last_generation")
    for df, name in ((records, "records"), (observations, "observations"), (candidates, "candidates")):
        out = out.join(n(df, name), "source", "left")
    return out.join(scrub, "source", "left").na.fill(0, ["records", "observations", "candidates", "cycles"])


def subscription_status(deliveries: DataFrame, now: int) -> DataFrame:
    open_ = F.col("state").isin("queued", "leased", "blocked")
    return deliveries.groupBy("sub").agg(F.count(F.lit(1)).alias("deliveries"), (now - F.min(F.when(open_, F.col("created_ms")))).alias("oldest_age_ms"), F.max(F.when(F.col("state") == "acknowledged", F.col("settled_ms"))).alias("last_acknowledged_ms"))


def scan_report(scans: DataFrame) -> DataFrame:
    """Counters of each generation (scans have bytes); the fixture's fingerprint says whether a candidate was unchanged, hashed or deferred."""
    is_ = lambda v: F.col("fp") == v
    return scans.groupBy("gen").agg(F.count(F.lit(1)).alias("considered"), F.count_if(is_(0)).alias("unchanged"), F.count_if(is_(1)).alias("hashed"), F.coalesce(F.sum(F.when(is_(1), F.col("bytes"))), F.lit(0)).alias("bytes_hashed"), F.count_if(is_(2)).alias("deferred"))


def manifests(deliveries: DataFrame) -> DataFrame:
    """sub, sequence and manifest, the JSON evidence of each delivery."""
    body = F.to_json(F.struct(F.lit(1).alias("format_version"), F.col("sub").alias("subscription"), "sequence", "record", "record_version", "kind", F.struct(F.col("root").alias("root_role")).alias("location")))
    return deliveries.select("sub", "sequence", body.alias("manifest"))


def applied(new: DataFrame, old: DataFrame) -> DataFrame:
    """For each manifest: fresh (none was written), same (an equal one was) or conflict (another was)."""
    o = old.select("sub", "sequence", F.col("manifest").alias("_m"))
    d = new.join(o, ["sub", "sequence"], "left")
    return d.select("sub", "sequence", F.col("_m").isNull().alias("fresh"), F.coalesce(F.col("_m") == F.col("manifest"), F.lit(False)).alias("same"), F.coalesce(F.col("_m") != F.col("manifest"), F.lit(False)).alias("conflict"))


def backup_boundary(events: DataFrame, manifest: DataFrame, schema_version: int) -> DataFrame:
    top = events.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("_top"))
    return manifest.join(top).select("schema_version", "latest_event_sequence", ((F.col("schema_version") == schema_version) & (F.col("latest_event_sequence") == F.col("_top"))).alias("valid"))


def run_summary(deliveries: DataFrame) -> DataFrame:
    return deliveries.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("deliveries"), F.count("settled_ms").alias("settled"))).alias("summary"))


def after_cursor(candidates: DataFrame, root: str, path: str) -> DataFrame:
    return candidates.where((F.col("root") > root) | ((F.col("root") == root) & (F.col("path") > path)))


def cache_admission(entries: DataFrame, most_each: int, most: int, most_bytes: int) -> DataFrame:
    """In order of path, the entries of each root that fit: each alone, and by number and total with those admitted before.
    An entry that is refused takes nothing, so later ones may still fit."""
    return folded(entries.where(F.col("bytes") <= most_each), "root", ["path"], "bytes", most_bytes, most).where("admitted").drop("admitted")


def upsert_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("record", F.col("fp").alias("_fp"), F.col("gen").alias("_gen"), F.col("unchanged").alias("_n"))
    d = new.join(o, "record", "full_outer")
    n = F.when(F.col("gen").isNull(), F.col("_n")).when(F.col("fp").eqNullSafe(F.col("_fp")), F.col("_n") + 1).otherwise(1)
    return d.select("record", F.coalesce("fp", "_fp").alias("fp"), F.coalesce("gen", "_gen").alias("gen"), n.alias("unchanged"))


def upsert_scrub(old: DataFrame, done: DataFrame) -> DataFrame:
    o = old.select("source", F.col("cycles").alias("_c"), F.col("last_gen").alias("_g"))
    d = done.join(o, "source", "full_outer")
    return d.select("source", (F.coalesce("_c", F.lit(0)) + F.col("last_gen").isNotNull().cast("int")).alias("cycles"), F.coalesce("last_gen", "_g").alias("last_gen"))


def upsert_last(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    return old.unionByName(new).groupBy(key).agg(F.max(value).alias(value))


def upsert_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("record", F.col("first_missing").alias("_f"), "scans")
    d = new.join(o, "record", "full_outer")
    return d.select("record", F.coalesce("_f", "first_missing").alias("first_missing"), (F.coalesce("scans", F.lit(0)) + F.col("first_missing").isNotNull().cast("int")).alias("scans"))


def purge(observations: DataFrame, generation: int) -> DataFrame:
    return observations.where(F.col("gen") >= generation)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def stale_scans(generations: DataFrame) -> DataFrame:
    top = generations.agg(F.max("gen").alias("_top"))
    return generations.join(F.broadcast(top)).select("gen", ((F.col("gen") < F.col("_top")) | F.col("counts")).alias("stale"))


def set_enabled(subscriptions: DataFrame, sub: int, enabled: bool) -> DataFrame:
    return subscriptions.withColumn("enabled", F.when(F.col("sub") == sub, F.lit(enabled)).otherwise(F.col("enabled")))


def high_water(deliveries: DataFrame) -> DataFrame:
    left = F.min(F.when(~F.col("state").isin(*RELEASING), F.col("sequence")))
    return deliveries.groupBy("sub").agg(F.coalesce(left - 1, F.max("sequence")).alias("high_water"))


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, chunk and digest of each piece of size characters; an empty text is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("long")
    d = docs.where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return d.select("doc_id", "chunk", F.sha2(F.substring(F.col("text"), F.col("chunk").cast("int") * size + 1, F.lit(size)), 256).alias("digest"))
