"""Operator 3, SimHash document fingerprints. DataFrame functions only.

A text's terms are its runs of two words (a text of one word: that word); a term's weight is its frequency. Each of the 64
bits of a term's XXH64 votes with that weight for 1 or 0, and the majority is the fingerprint's bit. ``near_pairs`` finds
all fingerprints within a Hamming radius by permuted block tables; ``near_counts`` and the query count with it, for each
document, the others within RADIUS bits.

Defined cases: a null, empty or blank text has no term and fingerprint 0. Equal texts have equal fingerprints. Repeated
rows are rows of their own. Null doc_ids come last in descending order; rows of one doc_id are ordered by their text's
hash and text. Of one row, the next document is itself. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, table, words, written
from .hamming import meet
from .near_dedup import hot_join
from .votes import hex16, vote

BITS = 64
#: The query counts the fingerprints that differ in so many bits at most; the tables' blocks.
RADIUS, BLOCKS = 3, 6
#: Rows aimed at in a range of the descending order.
RANGE_ROWS = 4000
MAX_RANGES = 10_000


def term_hashes(text: Column) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w)
        pairs = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        return F.when(n >= 2, pairs).otherwise(F.transform(w, lambda x: F.xxhash64(x)))

    return F.transform(F.array(words(text)), of)[0]


def fingerprint(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the fingerprint fp of text, for rows that keys tell apart."""
    return vote(df.select(*keys, term_hashes(F.col(text)).alias("_h")), keys, "_h").drop("m")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def near_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs a < b of the distinct fingerprints fp with 1 to radius differing bits, and their distance.

    The bits are cut into blocks; within the radius, blocks - radius of them at least are equal. For each choice of so many
    blocks there is a table that has them permuted to the front, as its key; fingerprints meet in it and are compared whole.
    """
    assert 0 < radius < blocks <= 16
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    f = fps.select("fp").distinct()
    part = [F.expr(f"shiftrightunsigned(fp, {lo}) & {(1 << hi - lo) - 1}L") for lo, hi in zip(cuts, cuts[1:], strict=False)]
    fronts = [F.xxhash64(F.lit(t), *[part[k] for k in choice]) for t, choice in enumerate(combinations(range(blocks), blocks - radius))]
    rows = f.select("fp", F.explode(F.array(*fronts)).alias("key"))
    met = meet(rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b"), radius).where("a < b")
    return met.select("a", "b", F.expr("bit_count(a ^ b)").alias("distance")).distinct()


def near_counts(fps: DataFrame) -> DataFrame:
    """fp, n and n_near for each distinct fp: its rows, and for each of them the other rows within RADIUS bits."""
    n = written(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fps")
    p = written(near_pairs(n).select("a", "b"), "pairs")
    both = p.union(p.select("b", "a")).toDF("fp", "other")
    links = both.join(n.select(F.col("fp").alias("other"), F.col("n").alias("m")), "other").groupBy("fp").agg(F.sum("m").alias("others"))
    out = written(n.join(links, "fp", "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")), "counts")
    release(n, p)
    return out


def in_descending_order(docs: DataFrame) -> DataFrame:
    """docs with _bucket and _rank (their place in descending doc_id) and _next, the next row's text; no row is last.

    Ranges of about RANGE_ROWS rows are cut at quantiles of doc_id; each is ordered on its own, and only the first row of
    each range is sent to the one before it. A doc_id at a cut is a range of its own, as null is, and ranges of one doc_id
    are cut further by their texts' hash, so rows that share a doc_id are spread, too.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = d.count()
    k = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    found = d.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 100 * k)).first()[0] if k > 1 else None
    cuts = sorted(set(found or []), reverse=True)
    place = F.coalesce(_place(F.col("doc_id"), cuts, 0, len(cuts)), F.lit(2 * len(cuts) + 1))
    bits = max(0, (n // RANGE_ROWS).bit_length() - 1) if k > 1 else 0
    alone = place % 2 == 1
    fine = F.shiftrightunsigned(F.col("_th").bitwiseXOR(F.lit(-(2**63))), 64 - bits) if bits else F.lit(0)
    d = d.withColumn("_th", F.xxhash64("text")).withColumn("_bucket", place.cast("long") * (1 << bits) + F.when(alone, fine).otherwise(0))
    w = W.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), "_th", "text")
    inside = d.withColumns({"_rank": F.row_number().over(w), "_next": F.lead("text").over(w)})
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("o"), "_th", "text")
    firsts = written(d.groupBy("_bucket").agg(F.min(order)["text"].alias("_first")), "firsts")
    to = _before(firsts)
    after = firsts.join(to, "_bucket").select(F.col("_to").alias("_bucket"), "_first")
    return inside.join(after.hint("shuffle_hash"), "_bucket").withColumn("_next", F.coalesce("_next", "_first")).drop("_first", "_th")


def _before(heads: DataFrame) -> DataFrame:
    """For each _bucket the one before it, _to; before the first is the last. Ranges are few beside rows."""
    w = W.orderBy("_bucket")
    last = F.max("_bucket").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return heads.select("_bucket").distinct().select("_bucket", F.coalesce(F.lag("_bucket").over(w), last).alias("_to"))


def _place(x: Column, cuts: list, lo: int, hi: int) -> Column:
    """By halving: twice the number of cuts (descending) over x, and one more for a cut itself. Null stays null."""
    if lo == hi:
        return F.when(x.isNotNull(), F.lit(2 * lo))
    mid = (lo + hi) // 2
    return F.when(x == cuts[mid], F.lit(2 * mid + 1)).when(x < cuts[mid], _place(x, cuts, mid + 1, hi)).otherwise(_place(x, cuts, lo, mid))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited and near_next for each row of docs."""
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("_next", third))
    d = in_descending_order(docs).select("_bucket", "_rank", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    two = d.select("_bucket", "_rank", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    key = ["_bucket", "_rank", "doc_id", "n_chars", "sha", "kind"]
    fps = fingerprint(two.select("_bucket", "_rank", "doc_id", "n_chars", "sha", "x.kind", "x.t"), key, "t")
    one = fps.groupBy("_bucket", "_rank", "doc_id", "n_chars", "sha").agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    one = written(one, "fp")
    w = W.partitionBy("_bucket").orderBy("_rank")
    heads = one.where("_rank = 1").select("_bucket", F.col("fp").alias("_head"))
    after = heads.join(_before(heads), "_bucket").select(F.col("_to").alias("_bucket"), "_head")
    out = one.withColumn("_n", F.lead("fp").over(w)).join(after, "_bucket").withColumn("_n", F.coalesce("_n", "_head"))
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("_n")).alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = written(fingerprint_edits(table(spark, sf_dir, "documents")), "edits")
    f = hot_join(f, near_counts(f.select("fp")), "fp", "n")
    return f.select("doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
