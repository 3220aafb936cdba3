"""Projections of the driver's tables onto the engine's data model, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import ledger as L

NOW = 1_706_745_600_000
#: Leases run on the first events only, so that subscriptions have some to give.
LEASED_UPTO = 110
SUBSCRIPTIONS = """SELECT * FROM (VALUES (1, 'everything', true, true, true, 50, 8, 1000, 60000), (2, 'no-moves', false, true, true, 20, 5, 500, 8000),
  (3, 'no-tombstones', true, false, false, 10, 3, 10, 40)) AS t(sub, consumer, moves, tombstones, enabled, max_leases, max_attempts, first_ms, most_ms)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long")
    return e.select(F.col("user_id").alias("record"), F.col("event_id").alias("o"), ms.alias("ms"), (F.col("event_type") != "error").alias("present"), (k % 3).alias("rev"), F.when(F.col("event_type") == "purchase", "archived").otherwise("active").alias("root"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger(observations(spark, sf_dir))


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.sql(SUBSCRIPTIONS)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("(sequence * 7 + sub) % 11")
    names = ("leased", "acknowledged", "ignored_by_policy", "superseded", "blocked", "dead_lettered")
    state = F.lit("queued")
    for n, s in enumerate(names):
        state = F.when(x == n, s).otherwise(state)
    state = F.when((x == 0) & (F.col("sequence") > LEASED_UPTO), "acknowledged").otherwise(state)
    d = ledger(spark, sf_dir).join(F.broadcast(subscriptions(spark).select("sub"))).withColumn("state", state)
    leased = F.col("state") == "leased"
    return d.withColumns({
        "attempts": (F.col("sequence") % 9).cast("int"),
        "expires_ms": F.when(leased, NOW + F.expr("(sequence * 13) % 200") - 100),
        "not_before_ms": F.when(F.col("state") == "queued", NOW + F.expr("(sequence * 5) % 100") - 80),
        "token": F.when(leased, F.sha2(F.concat_ws(":", "sub", "sequence", F.col("sequence") % 9), 256)),
        "created_ms": F.col("ms"),
        "settled_ms": F.when(F.col("state").isin(*names[1:4]), F.col("ms") + 1000),
        "reason": F.lit(None).cast("string"),
    }).drop("ms")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record, gen (the day of January) and fp, the last revision of the day."""
    o = observations(spark, sf_dir).withColumn("gen", F.expr(f"cast((ms - {DAY0}) div 86400000 + 1 as long)"))
    return o.groupBy("record", "gen").agg(F.max_by("rev", "o").alias("fp"))


DAY0 = 1_704_067_200_000


def generations(spark: SparkSession) -> DataFrame:
    g = spark.range(1, 32).withColumnRenamed("id", "gen")
    return g.select("gen", (DAY0 + F.col("gen") * 86_400_000).alias("ms"), (F.col("gen") % 7 != 0).alias("counts"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("root"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", F.octet_length("text").cast("long").alias("bytes"), "text")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    bad = spark.sql("SELECT col1 AS path FROM VALUES ('../x'), ('/x'), ('a//b'), ('a\\\\..\\\\b'), (''), ('a/./b'), ('ok/name'), (' lead'), ('trail '), ('./x'), ('.') AS t(col1)")
    return p.unionByName(bad)


CTE = f"""WITH obs AS (SELECT user_id AS record, event_id AS o, epoch_us(ts) // 1000 AS ms, event_type <> 'error' AS present,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 3 AS rev, CASE WHEN event_type = 'purchase' THEN 'archived' ELSE 'active' END AS root FROM events),
win AS (SELECT *, lag(present) OVER (PARTITION BY record ORDER BY o) AS was,
  last_value(CASE WHEN present THEN rev END IGNORE NULLS) OVER (PARTITION BY record ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_rev,
  last_value(CASE WHEN present THEN root END IGNORE NULLS) OVER (PARTITION BY record ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_root FROM obs),
chg AS (SELECT record, o, 0 AS sub, 'record_tombstoned' AS kind, prev_rev AS rev, prev_root AS root, ms FROM win WHERE NOT present AND was
  UNION ALL SELECT record, o, 0, 'record_restored', prev_rev, root, ms FROM win WHERE present AND NOT coalesce(was, false) AND prev_rev IS NOT NULL
  UNION ALL SELECT record, o, 1, 'revision_committed', rev, root, ms FROM win WHERE present AND (prev_rev IS NULL OR prev_rev <> rev)
  UNION ALL SELECT record, o, 1, 'location_changed', rev, root, ms FROM win WHERE present AND was AND prev_rev = rev AND prev_root <> root),
led AS (SELECT row_number() OVER (ORDER BY o, sub) AS sequence, record, row_number() OVER (PARTITION BY record ORDER BY o, sub) AS record_version, kind, rev, root, ms FROM chg),
cur AS (SELECT record, CASE WHEN arg_max(kind, record_version) = 'record_tombstoned' THEN 'tombstoned' ELSE 'active' END AS state, arg_max(rev, record_version) AS rev,
  arg_max(root, record_version) AS root, max(record_version) AS record_version, min(ms) AS created_ms, arg_max(ms, record_version) AS updated_ms FROM led GROUP BY record),
revs AS (SELECT record, rev, min(ms) AS first_ms, max(ms) AS last_ms FROM obs WHERE present GROUP BY record, rev),
subs AS ({SUBSCRIPTIONS}),
del0 AS (SELECT s.sub, l.*, CASE (l.sequence * 7 + s.sub) % 11 WHEN 0 THEN CASE WHEN l.sequence > {LEASED_UPTO} THEN 'acknowledged' ELSE 'leased' END WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'ignored_by_policy' WHEN 3 THEN 'superseded' WHEN 4 THEN 'blocked' WHEN 5 THEN 'dead_lettered' ELSE 'queued' END AS state FROM led l CROSS JOIN subs s),
del AS (SELECT sequence, record, record_version, kind, rev, root, sub, state, CAST(sequence % 9 AS INTEGER) AS attempts, CASE WHEN state = 'leased' THEN {NOW} + (sequence * 13) % 200 - 100 END AS expires_ms,
  CASE WHEN state = 'queued' THEN {NOW} + (sequence * 5) % 100 - 80 END AS not_before_ms, CASE WHEN state = 'leased' THEN sha256(concat_ws(':', sub, sequence, sequence % 9)) END AS token,
  ms AS created_ms, CASE WHEN state IN ('acknowledged', 'ignored_by_policy', 'superseded') THEN ms + 1000 END AS settled_ms, CAST(NULL AS VARCHAR) AS reason FROM del0),
exp AS (SELECT d.sequence, d.record, d.record_version, d.kind, d.rev, d.root, d.sub, CASE WHEN ov AND attempts >= max_attempts THEN 'dead_lettered' WHEN ov THEN 'queued' ELSE state END AS state, attempts,
  CASE WHEN ov THEN NULL ELSE expires_ms END AS expires_ms, CASE WHEN ov AND attempts < max_attempts THEN {NOW} + CAST(least(most_ms, first_ms * pow(2, least(attempts - 1, 63))) AS BIGINT) ELSE not_before_ms END AS not_before_ms,
  CASE WHEN NOT ov THEN token END AS token, created_ms, CASE WHEN ov AND attempts >= max_attempts THEN {NOW} WHEN NOT ov THEN settled_ms END AS settled_ms,
  CASE WHEN ov AND attempts >= max_attempts THEN 'retry policy exhausted after lease expiry' WHEN NOT ov THEN reason END AS reason FROM (SELECT *, state = 'leased' AND expires_ms <= {NOW} AS ov FROM del) d JOIN subs USING (sub)),
scn AS (SELECT record, CAST((ms - {DAY0}) // 86400000 + 1 AS BIGINT) AS gen, arg_max(rev, o) AS fp FROM obs GROUP BY 1, 2),
gens AS (SELECT CAST(range AS BIGINT) AS gen, {DAY0} + range * 86400000 AS ms, range % 7 <> 0 AS counts FROM range(1, 32)),
cand AS (SELECT lang AS root, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, doc_id, CAST(strlen(text) AS BIGINT) AS bytes, text FROM documents),
pth AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages UNION ALL SELECT * FROM (VALUES ('../x'), ('/x'), ('a//b'), ('a\\..\\b'), (''), ('a/./b'), ('ok/name'), (' lead'), ('trail '), ('./x'), ('.')) t(path))
"""
