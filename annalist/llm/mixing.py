"""Operator 7, mixing sources to target weights by a low-discrepancy schedule.

Sources, by code point and null last, weigh 1, 2, 3, repeating; a source's target is its share of all words by weight, at
most REPEATS times its own words, and what exceeds that is shared again by weight. The mix is a row of slots of SLOT_WORDS
words. A source gets as many slots as its target needs, the last of them cut to what is left, so it takes its target to the
word; a source with a target takes a word at least. Slot t is the golden-ratio point frac((t + 1) phi), and the source whose
part of the cumulative slots holds the point fills it, so every source is spread evenly over the mix. A source's slots are
ranked; those beyond its number go to the sources that came out short, few each, as the points' discrepancy is small.

Each source's documents, shuffled by a hash, are laid end to end, and again up to REPEATS times, and cut into blocks of a
slot's length. Blocks are joined to slots by source and rank: that gives the pieces of documents in the mix, each with its
slot. ``taken`` sums a document's pieces, and ``mix`` returns the documents in the order of their slots.

Nothing but a row for each source, or for each slot that changes hands, reaches one task. Ranks and places are prefix sums in
two levels (over small parts of a source, then within a part), so a hot source is spread over many tasks; the join's key has
the rank, so it is, too. Slots meet sources by an equi-join on cells.

Defined cases: a null, empty or blank text has size 0 and takes 0. Documents of one hash are ordered by doc_id, size and row;
repeated rows are rows of their own, null doc_ids a document each. A table without words has targets 0. Columns that clash
with those added here don't matter to ``mix``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, table, words, written

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Words in a slot; parts in which the documents of a source are ordered.
SLOT_WORDS = 256
PARTS = 512
#: frac(phi) and frac(2^20 phi): two steps keep points exact to 1e-10 up to 2^40 slots.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.607787409740351
#: Sources meet points in at least so many cells.
CELLS = 4096
_RUN = 65_536
#: Bytes of the table of sources up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target, a row for each source; sizes has source and size for each document.

    In the order of size to weight, sources below the water level are full at REPEATS times their size and the others share
    what is left; windows run over the sources' totals only.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * REPEATS)
    w = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("w").over(after)).withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    level = F.max(F.when(F.col("open"), F.struct(-F.col("cap") / F.col("w"), F.col("level")))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    return s.withColumn("l", level).select("source", "source_size", F.when(F.col("l").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("l") * F.col("w"))).alias("target"))


def plan(sizes: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """source, source_size, target, words (the target in whole words) and slots, a row for each source."""
    t = targets(sizes)
    n = F.when(F.col("target") > 0, F.least(F.greatest(F.lit(1), F.round("target").cast("long")), F.col("source_size") * REPEATS)).otherwise(0)
    return t.withColumn("words", n).withColumn("slots", F.expr(f"(words + {slot_words - 1}) div {slot_words}"))


def _few(sources: DataFrame) -> DataFrame:
    """The table of sources, to be broadcast if its rows and names together are small."""
    n = sources.agg((F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).alias("n")).first()[0]
    return F.broadcast(sources) if n <= BROADCAST_BYTES else sources


def _numbered(slots: DataFrame) -> DataFrame:
    """slots (slot, source) with rank, from 0 in each source by slot."""
    found = slots.withColumn("run", F.expr(f"slot div {_RUN}"))
    counts = found.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("source", "run").orderBy("slot")) - 1).alias("f")
    return ranked.join(counts.alias("c"), F.expr("f.run = c.run and f.source <=> c.source")).select("f.slot", "f.source", (F.col("f.r") + F.col("c.base")).alias("rank"))


def schedule(sources: DataFrame) -> DataFrame:
    """slot, source and rank for each slot of the mix; sources has source and slots, the number of slots that each fills.

    Every rank from 0 to slots - 1 of a source has one slot, and every slot one source and rank.
    """
    w = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    some = written(sources.where("slots > 0").select("source", "slots", F.sum("slots").over(w).alias("upto")), "slots")
    total = some.agg(F.coalesce(F.max("upto"), F.lit(0)), F.count(F.lit(1))).first()
    n, cells = total[0], max(CELLS, 1 << (4 * total[1]).bit_length())
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("long")
    part = some.select("source", ((F.col("upto") - F.col("slots")) / n).alias("lo"), (F.col("upto") / n).alias("hi")) if n else some.selectExpr("source", "0d as lo", "0d as hi")
    part = part.withColumn("hi", F.when(F.col("hi") >= 1, F.lit(2.0)).otherwise(F.col("hi")))
    part = part.select("source", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    t = F.col("slot") + 1
    point = F.expr(f"(slot + 1) div {1 << 20}") * GOLDEN_20 + F.pmod(t, F.lit(1 << 20)) * GOLDEN
    slots = sources.sparkSession.range(n).select(F.col("id").alias("slot")).withColumn("p", point - F.floor(point)).withColumn("cell", cell(F.col("p")))
    found = written(_numbered(slots.join(_few(part), "cell").where("p >= lo and p < hi").select("slot", "source")), "points")
    has = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    both = lambda a, b: F.expr(f"{a}.source <=> {b}.source")
    placed = found.alias("f").join(_few(some).alias("s"), both("f", "s")).select("f.*", "s.slots")
    free = placed.where("rank >= slots").select("slot").withColumn("nth", F.row_number().over(W.orderBy("slot")))
    short = some.alias("s").join(has.alias("h"), both("s", "h"), "left").select("s.source", "s.slots", F.coalesce("h.n", F.lit(0)).alias("n")).where("n < slots")
    short = short.select("source", "slots", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank"))
    short = short.withColumn("nth", F.row_number().over(W.orderBy(F.col("rank") / F.col("slots"), F.col("source").asc_nulls_last())))
    return placed.where("rank < slots").select("slot", "source", "rank").unionByName(short.join(free, "nth").select("slot", "source", "rank"))


def laid_out(sizes: DataFrame, parts: int = PARTS) -> DataFrame:
    """sizes (row, doc_id, source, size) with at, the words of its source before the document in shuffled order."""
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    d = sizes.withColumns({"_h": h, "_part": F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 64 - parts.bit_length() + 1)})
    sums = d.groupBy("source", "_part").agg(F.sum("size").alias("s"))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "_part").orderBy("_h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_in", inside).alias("d").join(sums.alias("s"), F.expr("d._part = s._part and d.source <=> s.source")).select("d.*", (F.col("d._in") + F.col("s.base")).alias("at")).drop("_h", "_part", "_in")


def blocks(sizes: DataFrame, sources: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """row, source, epoch, block, begin and length: what of each document lies in each block of its source, up to its words."""
    d = laid_out(sizes.where("size > 0")).alias("d").join(_few(sources).alias("s"), F.expr("d.source <=> s.source")).select("d.row", "d.source", "d.size", "d.at", "s.source_size", "s.words")
    rounds = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda e: F.struct(e.alias("epoch"), (F.col("at") + e * F.col("source_size")).alias("a")))
    d = d.select("row", "source", "size", "words", F.explode(F.filter(rounds, lambda x: x["a"] < F.col("words"))).alias("x"))
    d = d.select("row", "source", "x.epoch", "x.a", F.least(F.col("x.a") + F.col("size"), F.col("words")).alias("b"))
    d = d.withColumn("block", F.explode(F.expr(f"sequence(a div {slot_words}, (b - 1) div {slot_words})")))
    lo, hi = F.greatest(F.col("a"), F.col("block") * slot_words), F.least(F.col("b"), (F.col("block") + 1) * slot_words)
    return d.select("row", "source", "epoch", "block", (lo - F.col("a")).alias("begin"), (hi - lo).alias("length"))


def pieces(sizes: DataFrame, sources: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """row, slot, epoch, begin and length of each piece of the mix: the slot of rank r takes block r of its source."""
    b, s = blocks(sizes, sources, slot_words).alias("b"), schedule(sources).alias("s")
    return b.join(s, F.expr("b.source <=> s.source and b.block = s.rank")).select("b.row", "s.slot", "b.epoch", "b.begin", "b.length")


def mixed(docs: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_pieces and first_slot for each row of docs (doc_id, source, text)."""
    sizes = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    sources = written(plan(sizes, slot_words), "plan")
    took = pieces(sizes, sources, slot_words).groupBy("row").agg(F.sum("length").alias("taken"), F.count(F.lit(1)).alias("n_pieces"), F.min("slot").alias("first_slot"))
    d = sizes.alias("d").join(_few(sources).alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.source_size", "s.target")
    none = F.lit(0).cast("long")
    return d.join(took, "row", "left").withColumns({"taken": F.coalesce("taken", none), "n_pieces": F.coalesce("n_pieces", none)}).drop("row")


def mix(docs: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """The mixed documents, with the columns of docs, in the order of the slots in which they begin.

    A document comes once for each time it is taken; one that is taken in part is cut after so many words, joined by spaces.
    """
    names = ("doc_id", "source", "text")
    rows = written(aside(docs, names).withColumns({"_row": F.monotonically_increasing_id(), "_size": size_of(F.col("text"))}), "docs")
    sizes = rows.select(F.col("_row").alias("row"), "doc_id", "source", F.col("_size").alias("size"))
    takes = pieces(sizes, written(plan(sizes, slot_words), "plan"), slot_words).groupBy("row", "epoch").agg(F.min("slot").alias("_slot"), F.sum("length").alias("_take"))
    out = rows.join(takes, F.col("_row") == F.col("row")).repartitionByRange("_slot", "_row", "epoch").sortWithinPartitions("_slot", "_row", "epoch")
    cut = F.concat_ws(" ", F.slice(words(F.col("text")), F.lit(1), F.col("_take").cast("int")))
    text = F.when(F.col("_take") == F.col("_size"), F.col("text")).otherwise(cut)
    columns = [text.alias("text") if c == "text" else F.col(x) for c, x in zip(docs.columns, aside(docs, names).columns, strict=True)]
    out = out.select(*columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_slot")
