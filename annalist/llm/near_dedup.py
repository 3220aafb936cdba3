"""Operator 9, SimHash near-dedup by multi-index hashing. DataFrame functions only.

A fingerprint is the bit majority over the XXH64 hashes (seed 42) of all three-word shingles of a text, repeats
included. Two fingerprints link if they differ in at most two bits; groups are the connected components of links.

Links are found exactly. The 64 bits are two segments of 32. Of two linked fingerprints, either one segment is equal and
the other differs in at most two bits, or both differ in one bit. In the first case the pair meets under the equal
segment and one of three blocks of the other segment; in the second, the one whose differing bit of the high segment is 0
meets the other after that bit is set (the radius-1 ball of the segment, enumerated), together with an equal half of the
low segment. Every candidate's complete distance is verified. Keys have 42 bits at least, so tables stay sparse.

Fingerprints, not documents, are compared: copies collapse first, and a fingerprint has at most 2080 linked
fingerprints, so what is emitted is in proportion to the documents whatever the size of a group of copies. Where very many
fingerprints meet under one key, they are keyed more finely, see ``hamming.meet``.

Defined cases: a null, empty or blank text has no shingle and fingerprint 0, linked like any other. A text of one or two
words has one shingle, all its words. Repeated rows are documents of their own and link to each other. A null doc_id is a
document; its component_id is null only where no doc_id in its component is known. Columns beside doc_id and text are
ignored by ``near_groups``, kept by ``deduplicate`` whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, lower_ascii, release, table, words, written
from .graph import connected_components
from .hamming import meet
from .votes import hex16, vote

#: Fingerprints held by more than one document in HOT get their group's row by broadcast: at most HOT rows.
HOT = 1000
#: Of rows that are alike, so many at most are made in a task at a time.
RUN = 65_536


def shingle_hashes(text: Column) -> Column:
    """XXH64, seed 42, of each run of three words joined by a space."""
    return F.transform(F.array(words(lower_ascii(text))), _hashes)[0]


def _hashes(w: Column) -> Column:
    n = F.size(w)
    two = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, F.slice(w, 3, n - 2), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))
    return F.when(n >= 3, three).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (XXH64 of the text), fp and m, the number of rows, for each doc_id and text."""
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), shingle_hashes(F.col("text")).alias("h"))
    return vote(d, ["doc_id", "th"], "h")


def linked_pairs(fps: DataFrame) -> DataFrame:
    """All pairs a, b (a < b) of the distinct fingerprints in the column fp that differ in one or two bits."""
    f = fps.select("fp", F.expr("shiftrightunsigned(fp, 32)").alias("hi"), F.expr("fp & 4294967295L").alias("lo"))

    def key(kind: int, seg: str, part: str) -> str:
        return f"(({kind}L << 48) | (({seg}) << 16) | ({part}))"

    def blocks(x: str) -> list[str]:
        return [f"{x} & 2047", f"(shiftrightunsigned({x}, 11)) & 2047", f"shiftrightunsigned({x}, 22)"]

    def halves(x: str) -> list[str]:
        return [f"{x} & 65535", f"shiftrightunsigned({x}, 16)"]

    same = [key(i, "hi", p) for i, p in enumerate(blocks("lo"))] + [key(3 + i, "lo", p) for i, p in enumerate(blocks("hi"))]
    rest = [key(6 + i, "hi", p) for i, p in enumerate(halves("lo"))]
    ball = [f"transform(filter(sequence(0, 31), k -> (shiftrightunsigned(hi, k) & 1) = 0), k -> {key(6 + i, 'hi | shiftleft(1L, k)', p)})" for i, p in enumerate(halves("lo"))]
    index = f.select(F.col("fp").alias("b"), F.explode(F.expr(f"array({', '.join(same + rest)})")).alias("key"))
    probe = f.select(F.col("fp").alias("a"), F.explode(F.expr(f"concat(array({', '.join(same)}), {', '.join(ball)})")).alias("key"))
    near = meet(probe, index, 2).where("a < b or key >= (6L << 48)")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, n_near and component_id, a row for each row of docs."""
    each = written(fingerprints(docs), "fp")
    fps = written(each.groupBy("fp").agg(F.sum("m").alias("n"), F.min("doc_id").alias("least")), "fps")
    pairs = written(linked_pairs(fps), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    links = both.join(fps.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("others"))
    roots = written(connected_components(pairs.toDF("src", "dst")).select(F.col("node").alias("fp"), "root"), "root")
    least = roots.join(fps, "fp").groupBy("root").agg(F.min("least").alias("of_root"))
    at = roots.join(least, "root").select("fp", "of_root")
    info = fps.join(links, "fp", "left").join(at, "fp", "left").select(
        "fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("of_root", "least").alias("component_id")
    )
    info = written(info, "groups")
    release(fps, pairs, roots)
    return hot_join(_rows(each), info, "fp", "n")


def _rows(each: DataFrame) -> DataFrame:
    """A row for each of the m rows that each row stands for; those of very many are spread over tasks first."""
    runs = F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {RUN}"))
    more = each.where("m > 1").withColumn("run", F.explode(runs)).repartition("doc_id", "th", "run")
    more = more.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("m") - F.col("run") * RUN))))
    return each.where("m = 1").drop("m").unionByName(more.drop("m", "run", "one"))


def hot_join(rows: DataFrame, one: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to the table one, which has a row for every key and its number of rows in the column count.

    Keys with over 1/HOT of all rows, HOT of them at most, are broadcast; the rest are shuffled, none of them hot.
    """
    total = F.lit(one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0])
    cut = F.col(count) * HOT > total
    values = [c for c in one.columns if c not in (key, count)]
    most = one.where(cut).select(F.col(key), F.lit(True).alias("_hot"), *values)
    at = rows.join(F.broadcast(most), key, "left")
    cold = one.where(~cut).select(key, *values)
    return at.where("_hot").select(*rows.columns, *values).unionByName(rows.join(F.broadcast(most.select(key)), key, "left_anti").join(cold, key).select(*rows.columns, *values))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest doc_id stays, whole.

    Where no doc_id in a component is known, the one with the least XXH64 of its text stays. Of repeated rows one stays.
    """
    g = written(near_groups(docs), "near")
    known = g.where("doc_id = component_id")
    nulls = g.where("component_id is null")
    top = known.union(nulls).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_f")).agg(F.min("th").alias("_t"))
    unknown = F.lit(2**63 - 1)
    keep = top.select(F.coalesce("component_id", unknown).alias("_k"), "_t")
    own = aside(docs, ("doc_id", "text"))
    keyed = own.withColumns({"_k": F.coalesce("doc_id", unknown), "_t": F.xxhash64(F.coalesce("text", F.lit("")))})
    once = keyed.join(keep, ["_k", "_t"], "left_semi").groupBy("_k", "_t").agg(*[F.first(c).alias(c) for c in own.columns])
    return once.select(*own.columns).toDF(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "n_near", "component_id")
