"""The ledger engine's queries over the fixtures. Each has the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import ordering as O  # noqa: E741
from annalist.functions import scalars as S
from annalist.operators import catalog as C
from annalist.operators import delivery as D
from annalist.operators import ledger as L

from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = X.NOW


def query(sql: str, name: str = ""):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = X.CTE + sql
        return f

    return add


# Ledger


@query("SELECT * FROM led")
def ledger(s, d):
    return X.ledger(s, d)


@query("SELECT record, sequence, record_version FROM led")
def record_version(s, d):
    return X.ledger(s, d).select("record", "sequence", "record_version")


@query("SELECT sequence, record, kind FROM led")
def event_sequence(s, d):
    return X.ledger(s, d).select("sequence", "record", "kind")


@query("SELECT * FROM led WHERE sequence > 100")
def events_after(s, d):
    return X.ledger(s, d).where("sequence > 100").orderBy("sequence")


@query("SELECT * FROM cur")
def current_record(s, d):
    return L.current(X.ledger(s, d))


@query("SELECT * FROM cur WHERE record = 7")
def current_record_by_id(s, d):
    return L.current(X.ledger(s, d).where("record = 7"))


@query("SELECT coalesce(max(sequence), 0) AS latest FROM led")
def latest_sequence(s, d):
    return X.ledger(s, d).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("latest"))


@query("SELECT * FROM revs")
def revisions(s, d):
    return L.revisions(X.observations(s, d))


@query("SELECT c.record, c.state, c.rev, r.first_ms, r.last_ms FROM cur c LEFT JOIN revs r ON c.record = r.record AND c.rev = r.rev")
def record_revision(s, d):
    return L.current(X.ledger(s, d)).join(L.revisions(X.observations(s, d)), ["record", "rev"], "left").select("record", "state", "rev", "first_ms", "last_ms")


_STABLE = """, done AS (SELECT gen FROM gens WHERE counts),
 st AS (SELECT *, lag(fp) OVER w AS pf, lag(gen) OVER w AS pg FROM scn WINDOW w AS (PARTITION BY record ORDER BY gen)),
 br AS (SELECT *, CASE WHEN pg IS NULL OR pf <> fp OR EXISTS (SELECT 1 FROM done WHERE done.gen > pg AND done.gen < st.gen) THEN 1 ELSE 0 END AS b FROM st),
 isl AS (SELECT *, sum(b) OVER (PARTITION BY record ORDER BY gen) AS i FROM br)
SELECT record, gen, fp, CAST(row_number() OVER (PARTITION BY record, i ORDER BY gen) AS INTEGER) AS unchanged FROM isl"""


@query(_STABLE)
def stability(s, d):
    return L.stability(X.scans(s, d), X.generations(s).where("counts").select("gen"))


_TOMB = """, lst AS (SELECT s.record, g.gen, g.ms, max(s.gen) AS ls FROM (SELECT * FROM gens WHERE counts) g JOIN scn s ON s.gen <= g.gen GROUP BY 1, 2, 3),
 mis AS (SELECT *, row_number() OVER (PARTITION BY record, ls ORDER BY gen) AS n, min(ms) OVER (PARTITION BY record, ls) AS f FROM lst WHERE ls < gen),
 tmb AS (SELECT record, ls, min(gen) AS gen FROM mis WHERE n >= 2 AND ms - f >= 86400000 GROUP BY 1, 2)
SELECT record, gen, CAST(1704067200000 + gen * 86400000 AS BIGINT) AS ms FROM tmb"""


@query(_TOMB)
def tombstone_grace(s, d):
    return L.tombstones(X.scans(s, d).select("record", "gen"), X.generations(s), 2, 86_400_000)


# Scalars


def _paths(s, d):
    return X.paths(s, d)


_BAD = "path <> '' AND NOT list_has_any(string_split(replace(path, '\\', '/'), '/'), ['', '.', '..'])"


@query("SELECT path, path <> '' AND path = trim(path) AS valid FROM pth")
def valid_identifier(s, d):
    return _paths(s, d).select("path", S.valid_identifier(F.col("path")).alias("valid"))


@query(f"SELECT path, {_BAD} AS valid FROM pth")
def valid_path(s, d):
    return _paths(s, d).select("path", S.valid_path(F.col("path")).alias("valid"))


@query("SELECT path, CASE WHEN NOT starts_with(path, '/') AND string_split(path, '/')[1] <> '.' AND NOT list_contains(string_split(path, '/'), '..') AND len(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.'))) > 0 THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') END AS normal FROM pth")
def normalize_path(s, d):
    return _paths(s, d).select("path", S.normalized_path(F.col("path")).alias("normal"))


_NAMES_SQL = """, nam AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
 nm AS (SELECT doc_id, h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u FROM nam),
 nn AS (SELECT doc_id, u, 'sessions/' || CASE doc_id % 5 WHEN 0 THEN 'rollout-2024-' || u || '.jsonl' WHEN 1 THEN 'other-' || u || '.jsonl' WHEN 2 THEN 'rollout-x.jsonl' WHEN 3 THEN 'rollout-2024-' || replace(u, '-', 'z') || '.jsonl' ELSE 'rollout-' || u || '.txt' END AS path FROM nm)
"""


def _names(s, d):
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    u = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    n = F.when(F.expr("doc_id % 5 = 0"), F.concat(F.lit("rollout-2024-"), u, F.lit(".jsonl"))).when(F.expr("doc_id % 5 = 1"), F.concat(F.lit("other-"), u, F.lit(".jsonl"))).when(F.expr("doc_id % 5 = 2"), F.lit("rollout-x.jsonl")).when(F.expr("doc_id % 5 = 3"), F.concat(F.lit("rollout-2024-"), F.replace(u, F.lit("-"), F.lit("z")), F.lit(".jsonl"))).otherwise(F.concat(F.lit("rollout-"), u, F.lit(".txt")))
    return X.table(s, d, "documents").select("doc_id", u.alias("u"), F.concat(F.lit("sessions/"), n).alias("path"))


@query(_NAMES_SQL + "SELECT doc_id, path, doc_id % 5 IN (0, 2, 3) AS candidate FROM nn")
def candidate_name(s, d):
    return _names(s, d).select("doc_id", "path", S.is_candidate_name(F.col("path")).alias("candidate"))


_FILE = "CASE WHEN doc_id % 5 = 0 THEN 'ok' WHEN doc_id % 5 = 3 THEN 'error' ELSE 'skip' END"


@query(_NAMES_SQL + f"SELECT doc_id, {_FILE} AS status, CASE WHEN doc_id % 5 = 0 THEN u END AS session FROM nn")
def filename_session(s, d):
    f = S.filename_session(F.col("path"))
    n = _names(s, d)
    return n.select("doc_id", f["status"].alias("status"), f["session"].alias("session"))


_HEAD_SQL = _NAMES_SQL + """, hd AS (SELECT doc_id, u, CASE WHEN doc_id % 30 = 0 THEN reverse(substr(u, 1, 8)) || substr(u, 9) WHEN doc_id % 3 = 0 THEN u WHEN doc_id % 3 = 1 THEN reverse(u) END AS id FROM nn)"""


def _headers(s, d):
    id_ = F.when(F.expr("doc_id % 30 = 0"), F.concat(F.reverse(F.substring("u", 1, 8)), F.expr("substring(u, 9)"))).when(F.expr("doc_id % 3 = 0"), F.col("u")).when(F.expr("doc_id % 3 = 1"), F.reverse("u"))
    n = _names(s, d).withColumn("id", id_)
    head = F.when(F.col("id").isNotNull(), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("id")).alias("payload")))).otherwise(F.lit("{bad"))
    return n.withColumn("text", F.concat(head, F.lit("\nfirst\n")))


@query(_HEAD_SQL + "SELECT doc_id, CASE WHEN regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN id END AS session FROM hd")
def parse_header(s, d):
    return _headers(s, d).select("doc_id", S.header_session(F.col("text")).alias("session"))


@query(_HEAD_SQL + "SELECT doc_id, u AS name_session, id AS head_session FROM hd WHERE doc_id % 5 = 0 AND doc_id % 3 = 0 AND id <> u")
def identity_mismatch(s, d):
    h = _headers(s, d).select("doc_id", S.filename_session(F.col("path"))["session"].alias("name_session"), S.header_session(F.col("text")).alias("head_session"))
    return h.where("name_session <> head_session")


@query("SELECT doc_id, bytes AS byte_length, sha256(text) AS digest FROM cand")
def revision_key(s, d):
    r = S.revision_key(F.col("text"))
    return X.candidates(s, d).select("doc_id", r["byte_length"].alias("byte_length"), r["digest"].alias("digest"))


@query("SELECT doc_id, sha256(text) AS hex_digest, true AS back, true AS refused FROM cand")
def digest_hex(s, d):
    h = F.sha2("text", 256)
    return X.candidates(s, d).select("doc_id", h.alias("hex_digest"), (F.lower(F.hex(S.digest_bytes(h))) == h).alias("back"), S.digest_bytes(F.left(h, F.lit(63))).isNull().alias("refused"))


@query("SELECT record, gen, coalesce(fp <> lag(fp) OVER (PARTITION BY record ORDER BY gen), true) AS changed FROM scn")
def fingerprint_changed(s, d):
    w = W.partitionBy("record").orderBy("gen")
    return X.scans(s, d).select("record", "gen", (~F.col("fp").eqNullSafe(F.lag("fp").over(w))).alias("changed"))


@query("SELECT o, CAST(floor((ms - 1705000000000) / 1000.0) AS BIGINT) AS seconds, CAST(((ms - 1705000000000) - 1000 * CAST(floor((ms - 1705000000000) / 1000.0) AS BIGINT)) * 1000000 AS BIGINT) AS nanos FROM obs")
def time_parts(s, d):
    t = S.time_parts(F.col("ms") - 1_705_000_000_000)
    return X.observations(s, d).select("o", t["seconds"].alias("seconds"), t["nanos"].alias("nanos"))


@query("SELECT l.sequence, s.sub, CASE WHEN (kind = 'location_changed' AND NOT moves) OR (kind = 'record_tombstoned' AND NOT tombstones) THEN 'blocked' ELSE 'queued' END AS state FROM led l CROSS JOIN subs s")
def initial_state(s, d):
    return D.fanout(X.ledger(s, d), X.subscriptions(s)).select("sequence", "sub", "state")


@query("SELECT l.sequence, l.record, l.record_version, l.kind, l.rev, l.root, s.sub, CASE WHEN (kind = 'location_changed' AND NOT moves) OR (kind = 'record_tombstoned' AND NOT tombstones) THEN 'blocked' ELSE 'queued' END AS state FROM led l CROSS JOIN subs s")
def fanout(s, d):
    return D.fanout(X.ledger(s, d), X.subscriptions(s))


@query(f"SELECT sequence, sub, CAST({NOW} + least(most_ms, first_ms * pow(2, least(sequence % 70, 63))) AS BIGINT) AS not_before FROM led CROSS JOIN subs")
def backoff(s, d):
    e = X.ledger(s, d).join(F.broadcast(X.subscriptions(s)))
    return e.select("sequence", "sub", S.backoff(F.lit(NOW), F.col("sequence") % 70 + 1, F.col("first_ms").cast("long"), F.col("most_ms").cast("long")).alias("not_before"))


_OUT = "CASE sequence % 4 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'ignored_by_policy' WHEN 2 THEN 'superseded' ELSE 'dead_letter' END"


@query(f"SELECT sequence, CASE WHEN sequence % 4 = 3 THEN 'dead_lettered' ELSE {_OUT} END AS state, sequence % 4 <> 3 AS advancing FROM led")
def advances(s, d):
    e = X.ledger(s, d).withColumn("outcome", F.expr(_OUT))
    return e.select("sequence", S.outcome_state(F.col("outcome")).alias("state"), S.advances(F.col("outcome")).alias("advancing"))


@query("SELECT sub, sequence, 'record:' || record AS source, sub || ':' || sequence AS key FROM del")
def idempotency_key(s, d):
    return X.deliveries(s, d).select("sub", "sequence", S.source_ref(F.col("record")).alias("source"), S.idempotency_key(F.col("sub"), F.col("sequence")).alias("key"))


@query("SELECT doc_id, CASE WHEN bytes > 0 AND doc_id % 10 > 0 THEN bytes / CAST(doc_id % 10 AS DOUBLE) END AS rate FROM cand")
def throughput(s, d):
    return X.candidates(s, d).select("doc_id", S.throughput(F.col("bytes"), (F.col("doc_id") % 10).cast("double")).alias("rate"))


@query("SELECT sequence, kind FROM led WHERE kind NOT IN ('revision_committed', 'location_changed', 'record_tombstoned', 'record_restored')")
def enum_violations(s, d):
    return C.enum_violations(X.ledger(s, d), "kind", S.EVENT_KINDS).select("sequence", "kind")


@query("SELECT gen, CAST(gen AS BIGINT) AS latest_event_sequence, gen % 3 = 0 AS valid FROM gens")
def parse_manifest(s, d):
    g = X.generations(s)
    text = F.when(F.expr("gen % 3 = 2"), F.lit("{broken")).otherwise(F.to_json(F.struct(F.when(F.expr("gen % 3 = 0"), 1).otherwise(2).alias("format_version"), F.col("ms").alias("created_at_ms"), F.lit(9).alias("schema_version"), F.col("gen").alias("latest_event_sequence"), F.sha2(F.col("gen").cast("string"), 256).alias("configuration_digest"))))
    m = C.parsed_manifest(text)
    return g.select("gen", F.coalesce(m["latest_event_sequence"], F.col("gen")).alias("latest_event_sequence"), m["valid"].alias("valid"))


# Sources and catalog


@query("SELECT root, path FROM cand WHERE doc_id % 10 = 3")
def scan_allowlist(s, d):
    c = X.candidates(s, d)
    allowed = c.where("doc_id % 10 = 3").select("root", "path")
    return C.allowed(c.select("root", "path"), allowed)


@query("SELECT doc_id, doc_id % 2 = 0 AS intact FROM cand")
def verify_payload(s, d):
    c = X.candidates(s, d)
    kept = c.select("doc_id", F.when(F.expr("doc_id % 2 = 0"), F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("!")), 256)).alias("digest"), F.col("bytes").alias("byte_length"))
    return C.verified(c.select("doc_id", F.col("text").cast("binary").alias("content")), kept, "doc_id")


@query("SELECT root, count(*) FILTER (doc_id % 4 = 0) AS cycles, max(path) FILTER (doc_id % 3 = 0) AS cursor FROM cand GROUP BY root")
def scrub_progress(s, d):
    c = X.candidates(s, d)
    state = c.groupBy("root").agg(F.count_if(F.expr("doc_id % 4 = 0")).alias("cycles"), F.max(F.when(F.expr("doc_id % 3 = 0"), F.col("path"))).alias("cursor"))
    return C.scrub_progress(c.select("root").distinct(), state, "root")


@query("SELECT DISTINCT source FROM documents WHERE length(source) > 4")
def registration_conflict(s, d):
    r = X.table(s, d, "documents").select("source", F.lit("producer").alias("producer"), F.length("source").alias("version")).distinct()
    kept = r.withColumn("version", F.lit(4))
    return C.conflicts(r, kept, "source", ["producer", "version"]).select("source")


@query("SELECT record, count(DISTINCT rev) AS sources FROM obs GROUP BY record HAVING count(DISTINCT rev) > 1")
def ownership_conflict(s, d):
    return C.ownership_conflicts(X.observations(s, d).select("record", F.col("rev").alias("source")))


@query("SELECT DISTINCT record FROM obs WHERE record % 5 = 2")
def owned_by_source(s, d):
    o = X.observations(s, d).select("record").distinct()
    own = o.where("record % 5 = 2")
    return o.join(own, "record", "left_semi")


@query("SELECT root, gen AS generation, count(*) AS n FROM (SELECT root, (ms - 1704067200000) // 86400000 + 1 AS gen, record FROM obs WHERE present) GROUP BY root, gen HAVING count(*) > count(DISTINCT record)")
def duplicate_identity(s, d):
    o = X.observations(s, d).where("present").select("root", F.expr("(ms - 1704067200000) div 86400000 + 1").alias("generation"), "record")
    return C.duplicates(o, ["root", "generation"], "record")


@query("SELECT root, path, CASE root WHEN 'en' THEN '/data/en' WHEN 'de' THEN '/data/de' END AS root_path, root NOT IN ('en', 'de') AS missing FROM cand")
def root_lookup(s, d):
    roots = s.sql("SELECT * FROM VALUES ('en', '/data/en'), ('de', '/data/de') AS t(root, root_path)")
    return X.candidates(s, d).select("root", "path").join(F.broadcast(roots), "root", "left").withColumn("missing", F.col("root_path").isNull())


@query("SELECT source, CASE count(*) % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'reuse' ELSE 'refuse' END AS choice FROM documents GROUP BY source")
def epoch_choice(s, d):
    n = X.table(s, d, "documents").groupBy("source").agg((F.count(F.lit(1)) % 3).alias("n"))
    return n.select("source", C.epoch_choice(F.col("n")).alias("choice"))


@query("SELECT count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'tombstoned') AS tombstoned, (SELECT count(*) FROM revs) AS revisions, (SELECT count(DISTINCT record) FROM obs WHERE NOT present) AS candidates FROM cur")
def catalog_counts(s, d):
    o = X.observations(s, d)
    return C.catalog_counts(L.current(X.ledger(s, d)), L.revisions(o), o.where("not present").select("record").distinct())


_SRC = """, src AS (SELECT record % 5 AS source, max(gen) AS last_generation, count(DISTINCT record) AS records, count(*) AS observations FROM scn GROUP BY 1)
SELECT s.source, s.last_generation + 1 AS next_generation, s.last_generation, s.records, s.observations, (SELECT count(*) FROM (SELECT DISTINCT record FROM obs WHERE NOT present) t WHERE t.record % 5 = s.source) AS candidates, CASE WHEN s.source < 3 THEN s.source ELSE 0 END AS cycles FROM src s"""


@query(_SRC)
def source_status(s, d):
    sc = X.scans(s, d).withColumn("source", F.col("record") % 5)
    state = sc.groupBy("source").agg(F.max("gen").alias("last_generation"))
    gone = X.observations(s, d).where("not present").select("record").distinct().select((F.col("record") % 5).alias("source"))
    scrub = s.range(3).select(F.col("id").alias("source"), F.col("id").alias("cycles"))
    return C.source_status(state, sc.select("source", "record").distinct(), sc, gone, scrub)


_SUBST = f"SELECT sub, count(*) AS deliveries, {NOW} - min(created_ms) FILTER (state IN ('queued', 'leased', 'blocked')) AS oldest_age_ms, max(settled_ms) FILTER (state = 'acknowledged') AS last_acknowledged_ms FROM del GROUP BY sub"


@query(_SUBST)
def subscription_status(s, d):
    return C.subscription_status(X.deliveries(s, d), NOW)


_STATES = "('queued', 'leased', 'acknowledged', 'ignored_by_policy', 'superseded', 'blocked', 'dead_lettered')"


@query("SELECT sub, " + ", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in S.DELIVERY_STATES) + " FROM del GROUP BY sub")
def delivery_counts(s, d):
    return D.counts(X.deliveries(s, d))


@query("SELECT 9 AS schema_version, (SELECT max(sequence) FROM led) AS latest_sequence, (SELECT count(*) FROM cur WHERE state = 'active') AS active, (SELECT count(*) FROM cur WHERE state = 'tombstoned') AS tombstoned, (SELECT count(*) FROM revs) AS revisions, (SELECT count(*) FROM del WHERE state = 'dead_lettered') AS dead_letters")
def catalog_status(s, d):
    e = X.ledger(s, d)
    c = L.current(e).agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "tombstoned").alias("tombstoned"))
    return e.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("latest_sequence")).join(c).join(L.revisions(X.observations(s, d)).agg(F.count(F.lit(1)).alias("revisions"))).join(X.deliveries(s, d).agg(F.count_if(F.col("state") == "dead_lettered").alias("dead_letters"))).withColumn("schema_version", F.lit(9))


_REP = "SELECT gen, count(*) AS considered, count(*) FILTER (fp = 0) AS unchanged, count(*) FILTER (fp = 1) AS hashed, coalesce(sum(bytes) FILTER (fp = 1), 0)::BIGINT AS bytes_hashed, count(*) FILTER (fp = 2) AS deferred FROM scn LEFT JOIN cand ON cand.doc_id = scn.record GROUP BY gen"


@query(_REP)
def scan_report(s, d):
    return C.scan_report(_sized(s, d))


def _sized(s, d):
    """Scans with the bytes of a candidate for each record."""
    return X.scans(s, d).join(X.candidates(s, d).select(F.col("doc_id").alias("record"), "bytes"), "record", "left")


@query(f", rep AS ({_REP}) SELECT sum(considered)::BIGINT AS considered, sum(unchanged)::BIGINT AS unchanged, sum(hashed)::BIGINT AS hashed, sum(bytes_hashed)::BIGINT AS bytes_hashed, sum(deferred)::BIGINT AS deferred, count(*) AS passes FROM rep")
def reconcile_totals(s, d):
    r = C.scan_report(_sized(s, d))
    return r.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in r.columns if c != "gen"], F.count(F.lit(1)).alias("passes"))


# Joins and barriers


@query("SELECT d.sub, d.sequence, d.rev, r.first_ms FROM del d LEFT JOIN revs r ON d.record = r.record AND d.rev = r.rev")
def delivery_revision(s, d):
    return X.deliveries(s, d).join(L.revisions(X.observations(s, d)), ["record", "rev"], "left").select("sub", "sequence", "rev", "first_ms")


_REL = "('acknowledged', 'ignored_by_policy', 'superseded')"
_BARRIER = f"SELECT d.sub, d.sequence, d.state FROM del d WHERE NOT EXISTS (SELECT 1 FROM del b WHERE b.sub = d.sub AND b.record = d.record AND b.record_version < d.record_version AND b.state NOT IN {_REL})"


@query(_BARRIER)
def barrier_anti(s, d):
    return D.barrier_anti(X.deliveries(s, d)).select("sub", "sequence", "state")


@query(_BARRIER)
def barrier_window(s, d):
    return D.barrier_window(X.deliveries(s, d)).select("sub", "sequence", "state")


# Delivery


@query("SELECT * FROM exp")
def expire_leases(s, d):
    return D.expire(X.deliveries(s, d), X.subscriptions(s), NOW)


_LEASE = f""", rdy AS (SELECT e.*, max_leases, (SELECT count(*) FROM exp a WHERE a.sub = e.sub AND a.state = 'leased') AS active FROM exp e JOIN subs USING (sub)
  WHERE enabled AND e.state = 'queued' AND (not_before_ms IS NULL OR not_before_ms <= {NOW}) AND NOT EXISTS (SELECT 1 FROM exp b WHERE b.sub = e.sub AND b.record = e.record AND b.record_version < e.record_version AND b.state NOT IN {_REL})),
 rnk AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY sequence) AS nth FROM rdy)
SELECT sub, CAST(nth AS INTEGER) AS nth, sequence, record, record_version, kind, rev, attempts + 1 AS attempts, CAST({NOW} + 5000 AS BIGINT) AS expires_ms, sha256(concat_ws(':', sub, sequence, attempts + 1)) AS token FROM rnk WHERE nth <= max_leases - active"""


@query(_LEASE)
def lease_batch(s, d):
    return D.lease(X.deliveries(s, d), X.subscriptions(s), NOW, 5000)


@query(_LEASE.replace("nth <= max_leases - active", "nth = 1 AND nth <= max_leases - active"))
def lease_topk(s, d):
    return D.lease(X.deliveries(s, d), X.subscriptions(s), NOW, 5000).where("nth = 1")


def _requests(s, d):
    x = X.deliveries(s, d).where("state = 'leased'")
    return x.select("sub", "sequence", F.when(F.expr("sequence % 2 = 0"), F.col("token")).otherwise("stale").alias("token"), F.expr(_OUT).alias("outcome"), F.concat(F.lit("because "), F.col("sequence").cast("string")).alias("reason"))


_OK = f"state = 'leased' AND sequence % 2 = 0 AND expires_ms > {NOW}"
_DCOLS = "sequence, record, record_version, kind, rev, root, sub, attempts, created_ms"
_WHY = "'because ' || sequence"
_GONE = f"CASE WHEN {_OK} THEN NULL ELSE token END AS token, CASE WHEN {_OK} THEN NULL ELSE expires_ms END AS expires_ms"


@query(f"SELECT sub, sequence, CASE WHEN sequence % 2 = 0 THEN token ELSE 'stale' END AS token, {_OUT} AS outcome, {_WHY} AS reason, {_OK} AS valid FROM del WHERE state = 'leased'")
def compare_and_set(s, d):
    return D.compare_and_set(X.deliveries(s, d), _requests(s, d), NOW)


@query(f"SELECT {_DCOLS}, not_before_ms, {_GONE}, CASE WHEN {_OK} THEN CASE WHEN sequence % 4 = 3 THEN 'dead_lettered' ELSE {_OUT} END ELSE state END AS state, CASE WHEN {_OK} THEN {NOW} ELSE settled_ms END AS settled_ms, CASE WHEN {_OK} THEN {_WHY} ELSE reason END AS reason FROM del")
def settle(s, d):
    return D.settle(X.deliveries(s, d), _requests(s, d), NOW)


@query(f"SELECT {_DCOLS}, {_GONE}, CASE WHEN {_OK} AND attempts < max_attempts THEN CAST({NOW} + least(most_ms, first_ms * pow(2, least(attempts - 1, 63))) AS BIGINT) ELSE not_before_ms END AS not_before_ms, CASE WHEN NOT ({_OK}) OR expires_ms IS NULL THEN state WHEN attempts >= max_attempts THEN 'dead_lettered' ELSE 'queued' END AS state, CASE WHEN NOT ({_OK}) OR expires_ms IS NULL THEN settled_ms WHEN attempts >= max_attempts THEN {NOW} END AS settled_ms, CASE WHEN NOT ({_OK}) OR expires_ms IS NULL THEN reason WHEN attempts >= max_attempts THEN 'retry policy exhausted' END AS reason FROM del JOIN subs USING (sub)")
def retry(s, d):
    return D.retry(X.deliveries(s, d), _requests(s, d), X.subscriptions(s), NOW)


@query(f"SELECT {_DCOLS}, not_before_ms, {_GONE}, CASE WHEN {_OK} THEN 'blocked' ELSE state END AS state, CASE WHEN {_OK} THEN NULL ELSE settled_ms END AS settled_ms, CASE WHEN {_OK} THEN {_WHY} ELSE reason END AS reason FROM del")
def block(s, d):
    return D.block(X.deliveries(s, d), _requests(s, d), NOW)


@query("SELECT sequence, record, record_version, kind, rev, root FROM led WHERE sequence > 50")
def replay(s, d):
    return D.replay(X.ledger(s, d), 50)


@query("SELECT CAST(NULL AS BIGINT) AS sequence, record, record_version, 'revision_committed' AS kind, rev, root FROM cur WHERE state = 'active'")
def rebuild(s, d):
    return D.rebuild(L.current(X.ledger(s, d)))


@query("SELECT r.sub, s.max_leases, s.enabled, s.sub IS NULL AS unknown FROM range(1, 6) t(sub0) JOIN (SELECT CAST(range AS INTEGER) AS sub FROM range(1, 6)) r ON r.sub = t.sub0 LEFT JOIN subs s ON s.sub = r.sub")
def admission(s, d):
    asked = s.range(1, 6).select(F.col("id").cast("int").alias("sub"))
    return asked.join(F.broadcast(X.subscriptions(s).select("sub", "max_leases", "enabled", F.lit(True).alias("_k"))), "sub", "left").select("sub", "max_leases", "enabled", F.col("_k").isNull().alias("unknown"))


_RUN = f""", sz AS (SELECT rev, 100 * (rev + 1) AS bytes FROM range(0, 3) t(rev)),
 st AS (SELECT e.*, e.state = 'queued' AND (not_before_ms IS NULL OR not_before_ms <= {NOW}) AS ready, (SELECT count(*) FROM exp a WHERE a.sub = e.sub AND a.state = 'leased') AS active FROM exp e),
 ok AS (SELECT st.*, sz.bytes, row_number() OVER (PARTITION BY st.sub ORDER BY sequence) AS nth FROM st JOIN subs USING (sub) LEFT JOIN sz ON sz.rev = st.rev WHERE enabled AND ready AND active < max_leases
  AND NOT EXISTS (SELECT 1 FROM st b WHERE b.sub = st.sub AND b.record = st.record AND b.record_version < st.record_version AND NOT b.ready AND b.state NOT IN {_REL})),
 tot AS (SELECT *, sum(bytes) OVER (PARTITION BY sub ORDER BY nth) AS t FROM ok WHERE nth <= 40),
 ovr AS (SELECT *, CASE WHEN t > 2500 THEN 'deferred_by_byte_budget' WHEN sub = 2 AND sequence % 5 = 3 THEN 'blocked' WHEN sub = 3 AND sequence % 5 = 3 THEN 'retried' END AS o FROM tot),
 ovn AS (SELECT *, count(o) OVER (PARTITION BY sub ORDER BY nth) AS n FROM ovr)
SELECT sub, CAST(nth AS INTEGER) AS nth, sequence, CAST(bytes AS BIGINT) AS bytes, coalesce(o, 'settled') AS outcome FROM ovn WHERE n = 0 OR (o IS NOT NULL AND n = 1)"""


@query(_RUN)
def controlled_run(s, d):
    sizes = s.range(3).select(F.col("id").alias("rev"), (F.col("id") * 100 + 100).alias("bytes"))
    e = X.deliveries(s, d)
    trouble = F.when(F.expr("sequence % 5 = 3 and sub = 2"), "blocked").when(F.expr("sequence % 5 = 3 and sub = 3"), "retried")
    return D.controlled_run(e, X.subscriptions(s), sizes, NOW, 40, 2500, trouble)


@query("SELECT sub, sequence, CASE WHEN kind <> 'record_tombstoned' THEN 'acknowledged' ELSE 'ignored_by_policy' END AS outcome FROM del")
def receipt_outcome(s, d):
    payload = F.when(F.col("kind") != "record_tombstoned", F.col("rev"))
    return X.deliveries(s, d).select("sub", "sequence", S.receipt_outcome(payload).alias("outcome"))


_MANIFEST = """'{"format_version":1,"subscription":' || sub || ',"sequence":' || sequence || ',"record":' || record || ',"record_version":' || record_version || ',"kind":"' || kind || '","location":{"root_role":"' || root || '"}'"""


@query(f"SELECT sub, sequence, {_MANIFEST} || '}}' AS manifest FROM del WHERE state = 'leased'")
def evidence_manifest(s, d):
    return C.manifests(X.deliveries(s, d).where("state = 'leased'"))


@query("SELECT sub, sequence, sequence % 6 < 3 AS fresh, sequence % 6 BETWEEN 3 AND 4 AS same, sequence % 6 = 5 AS conflict FROM del WHERE state = 'leased'")
def receipts(s, d):
    new = C.manifests(X.deliveries(s, d).where("state = 'leased'"))
    old = new.where("sequence % 6 >= 3").withColumn("manifest", F.when(F.expr("sequence % 6 = 5"), F.lit("{}")).otherwise(F.col("manifest")))
    return C.applied(new, old)


@query("SELECT CAST(9 AS INTEGER) AS schema_version, max(sequence) AS latest_event_sequence, true AS valid FROM led")
def backup_boundary(s, d):
    e = X.ledger(s, d)
    m = e.agg(F.max("sequence").alias("latest_event_sequence"), F.lit(9).alias("schema_version"))
    return C.backup_boundary(e, m, 9)


@query("SELECT '{\"deliveries\":' || count(*) || ',\"settled\":' || count(*) FILTER (settled_ms IS NOT NULL) || '}' AS summary FROM del")
def run_summary(s, d):
    return C.run_summary(X.deliveries(s, d))


_U = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@query(_NAMES_SQL + ", fl AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'lease-' || sha256(u) || '-' || u || '.payload' WHEN 1 THEN '.lease-' || sha256(u) || '-' || u || '.partial' WHEN 2 THEN 'lease-' || u || '.payload' ELSE 'notes.txt' END AS name FROM nn) SELECT doc_id, name, doc_id % 4 < 2 AS owned FROM fl")
def orphan_match(s, d):
    h = F.sha2("u", 256)
    name = F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("lease-"), h, F.lit("-"), "u", F.lit(".payload"))).when(F.expr("doc_id % 4 = 1"), F.concat(F.lit(".lease-"), h, F.lit("-"), "u", F.lit(".partial"))).when(F.expr("doc_id % 4 = 2"), F.concat(F.lit("lease-"), "u", F.lit(".payload"))).otherwise("notes.txt")
    return _names(s, d).select("doc_id", name.alias("name")).withColumn("owned", S.owned_name(F.col("name")))


# Budgets


@query(", c AS (SELECT root, path, bytes FROM cand WHERE bytes <= 5000) SELECT root, path, bytes FROM c")
def size_limit(s, d):
    return X.candidates(s, d).where("bytes <= 5000").select("root", "path", "bytes")


_GREEDY = """SELECT * FROM (WITH RECURSIVE c AS (SELECT lang AS root, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, CAST(strlen(text) AS BIGINT) AS bytes FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS i FROM c),
f AS (SELECT root, path, bytes, i, true AS admitted, bytes AS used FROM n WHERE i = 1
 UNION ALL SELECT n.root, n.path, n.bytes, n.i, f.used = 0 OR f.used + n.bytes <= 60000, f.used + CASE WHEN f.used = 0 OR f.used + n.bytes <= 60000 THEN n.bytes ELSE 0 END FROM f JOIN n ON n.root = f.root AND n.i = f.i + 1)
SELECT root, path, bytes, admitted FROM f)"""


@query("")
def hash_budget(s, d):
    return O.greedy_budget(X.candidates(s, d).select("root", "path", "bytes"), "root", ["path"], "bytes", 60_000)


SQL["hash_budget"] = _GREEDY
_PREFIX = ", t AS (SELECT root, path, bytes, sum(bytes) OVER w AS upto FROM cand WINDOW w AS (PARTITION BY root ORDER BY path)), u AS (SELECT *, max(CASE WHEN upto - bytes > 0 AND upto > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY path) AS stop FROM t) SELECT root, path, bytes, stop = 0 AS admitted FROM u"


@query(_PREFIX)
def scrub_budget(s, d):
    return O.prefix_budget(X.candidates(s, d).select("root", "path", "bytes"), "root", ["path"], "bytes", 60_000)


@query("SELECT root, path FROM cand WHERE root > 'en' OR (root = 'en' AND path > 'src5/')")
def scrub_resume(s, d):
    return C.after_cursor(X.candidates(s, d).select("root", "path"), "en", "src5/")


@query(", t AS (SELECT root, path, doc_id, bytes, sum(bytes) OVER w AS upto FROM cand WHERE (root > 'en' OR (root = 'en' AND path > 'src5/')) WINDOW w AS (PARTITION BY root ORDER BY path)), u AS (SELECT *, max(CASE WHEN upto - bytes > 0 AND upto > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY path) AS stop FROM t) SELECT root, path, bytes FROM u WHERE stop = 0 AND doc_id % 2 = 0")
def scrub(s, d):
    c = X.candidates(s, d)
    owned = c.where("doc_id % 2 = 0").select("root", "path")
    page = O.prefix_budget(C.after_cursor(c.select("root", "path", "bytes"), "en", "src5/"), "root", ["path"], "bytes", 60_000).where("admitted")
    return page.join(owned, ["root", "path"], "left_semi").select("root", "path", "bytes")


_CACHE = """SELECT * FROM (WITH RECURSIVE c AS (SELECT lang AS root, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, CAST(strlen(text) AS BIGINT) AS bytes FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS i FROM c WHERE bytes <= 3000),
f AS (SELECT root, path, bytes, i, bytes <= 20000 AS admitted, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END AS used, CASE WHEN bytes <= 20000 THEN 1 ELSE 0 END AS taken FROM n WHERE i = 1
 UNION ALL SELECT n.root, n.path, n.bytes, n.i, f.taken < 20 AND f.used + n.bytes <= 20000, f.used + CASE WHEN f.taken < 20 AND f.used + n.bytes <= 20000 THEN n.bytes ELSE 0 END, f.taken + CASE WHEN f.taken < 20 AND f.used + n.bytes <= 20000 THEN 1 ELSE 0 END FROM f JOIN n ON n.root = f.root AND n.i = f.i + 1)
SELECT root, path, bytes FROM f WHERE admitted)"""


@query("")
def cache_admission(s, d):
    return C.cache_admission(X.candidates(s, d).select("root", "path", "bytes"), 3000, 20, 20_000)


SQL["cache_admission"] = _CACHE

# Mutations: the snapshot after the change


@query(", old AS (SELECT * FROM scn WHERE gen = 3), new AS (SELECT * FROM scn WHERE gen = 4) SELECT coalesce(n.record, o.record) AS record, coalesce(n.fp, o.fp) AS fp, coalesce(n.gen, o.gen) AS gen, CASE WHEN n.record IS NULL OR o.record IS NULL OR n.fp <> o.fp THEN 1 ELSE 2 END AS unchanged FROM new n FULL JOIN old o ON n.record = o.record")
def upsert_observation(s, d):
    x = X.scans(s, d)
    old = x.where("gen = 3").withColumn("unchanged", F.lit(1))
    return C.upsert_observations(old, x.where("gen = 4"))


@query("SELECT record % 5 AS source, CASE WHEN record % 5 < 3 THEN 2 ELSE 1 END AS cycles, max(gen) AS last_gen FROM scn GROUP BY 1, 2")
def upsert_scrub(s, d):
    old = s.range(3).select(F.col("id").alias("source"), F.lit(1).alias("cycles"), F.lit(0).cast("long").alias("last_gen"))
    done = X.scans(s, d).groupBy((F.col("record") % 5).alias("source")).agg(F.max("gen").alias("last_gen"))
    return C.upsert_scrub(old, done)


@query("SELECT record, max(gen) AS last_seen FROM scn WHERE gen <= 6 GROUP BY record")
def upsert_presence(s, d):
    x = X.scans(s, d)
    old = x.where("gen <= 5").groupBy("record").agg(F.max("gen").alias("last_seen"))
    return C.upsert_last(old, x.where("gen = 6").select("record", F.col("gen").alias("last_seen")), "record", "last_seen")


@query(", old AS (SELECT record, min(o) AS first_missing, 1 AS scans FROM obs WHERE NOT present AND o % 2 = 0 GROUP BY record), new AS (SELECT record, max(o) AS first_missing FROM obs WHERE NOT present GROUP BY record) SELECT coalesce(o.record, n.record) AS record, coalesce(o.first_missing, n.first_missing) AS first_missing, CASE WHEN n.record IS NULL THEN o.scans ELSE coalesce(o.scans, 0) + 1 END AS scans FROM old o FULL JOIN new n ON o.record = n.record")
def upsert_candidate(s, d):
    m = X.observations(s, d).where("not present")
    old = m.where("o % 2 = 0").groupBy("record").agg(F.min("o").alias("first_missing")).withColumn("scans", F.lit(1))
    return C.upsert_candidates(old, m.groupBy("record").agg(F.max("o").alias("first_missing")))


@query("SELECT record, gen, fp FROM scn WHERE gen >= 15")
def purge_stale(s, d):
    return C.purge(X.scans(s, d), 15)


@query("SELECT record, rev, min(first_ms) AS first_ms FROM revs GROUP BY record, rev")
def insert_revision(s, d):
    r = L.revisions(X.observations(s, d)).select("record", "rev", "first_ms")
    return C.insert_absent(r.where("record % 2 = 0"), r, ["record", "rev"])


@query("SELECT coalesce(max(gen), 0) + 1 AS generation FROM scn")
def next_generation(s, d):
    return X.scans(s, d).agg((F.coalesce(F.max("gen"), F.lit(0)) + 1).alias("generation"))


@query("SELECT gen, gen < (SELECT max(gen) FROM gens) OR counts AS stale FROM gens")
def stale_scan(s, d):
    return C.stale_scans(X.generations(s))


@query("SELECT sub, consumer, moves, tombstones, enabled AND sub <> 1 AS enabled, max_leases, max_attempts, first_ms, most_ms FROM subs")
def pause(s, d):
    return C.set_enabled(X.subscriptions(s), 1, False)


_RECONCILE = _STABLE.replace("SELECT record, gen, fp, CAST(row_number() OVER (PARTITION BY record, i ORDER BY gen) AS INTEGER) AS unchanged FROM isl", """, run AS (SELECT record, gen, fp, i, row_number() OVER (PARTITION BY record, i ORDER BY gen) AS unchanged FROM isl),
 rec AS (SELECT record, gen, fp, CASE WHEN unchanged < 2 THEN 'awaiting_stability' WHEN coalesce(bytes, 0) > 5000 THEN 'deferred_by_size_limit' WHEN unchanged > 2 THEN 'already_stable' ELSE 'hashed' END AS outcome FROM run LEFT JOIN cand ON cand.doc_id = run.record)
""")


@query(_RECONCILE + "SELECT record, gen, fp, outcome FROM rec")
def reconcile(s, d):
    """What a scan does with each candidate: it waits, is stable already, is too large, or is hashed. Budgets are unlimited."""
    return L.reconcile(_sized(s, d), X.generations(s).where("counts").select("gen"), 2, 5000)


@query(_RECONCILE + ", hsh AS (SELECT record, gen, fp, lag(fp) OVER (PARTITION BY record ORDER BY gen) AS last FROM rec WHERE outcome = 'hashed') SELECT record, gen, fp FROM hsh WHERE last IS NULL OR last <> fp")
def scan_pipeline(s, d):
    """The revisions that scans commit: what they hash, if it isn't what the record had before."""
    return L.committed(L.reconcile(_sized(s, d), X.generations(s).where("counts").select("gen"), 2, 5000))


# Extensions that the reference only describes


@query("SELECT sub, coalesce(min(sequence) FILTER (state NOT IN ('acknowledged', 'ignored_by_policy', 'superseded')) - 1, max(sequence)) AS high_water FROM del GROUP BY sub")
def ext_high_water(s, d):
    return C.high_water(X.deliveries(s, d))


@query("SELECT sub, record, max(record_version) AS record_version FROM del WHERE state = 'queued' GROUP BY sub, record")
def ext_latest_only(s, d):
    return X.deliveries(s, d).where("state = 'queued'").groupBy("sub", "record").agg(F.max("record_version").alias("record_version"))


@query(", ch AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS chunk FROM documents WHERE text IS NOT NULL) SELECT doc_id, chunk, sha256(substr(text, chunk * 1000 + 1, 1000)) AS digest FROM ch")
def ext_chunks(s, d):
    return C.chunks(X.table(s, d, "documents").select("doc_id", "text"), 1000)
