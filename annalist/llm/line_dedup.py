"""Operator 4, removal of repeated passages, word by word, by winnowing.

A passage is any MIN_WORDS words in a row, wherever lines and sentences end. What is removed is each passage that stands at
an earlier place of the corpus (by doc_id, text hash, place), in another text or the same one; passages that overlap or
adjoin go as one run. So a run of MIN_WORDS words or more is removed from the later place to the word, and the first place
of any passage always stays.

Of the grams of GRAM_WORDS words in a passage, the one with the least hash is its fingerprint, so equal passages have equal
fingerprints. Passages whose fingerprint stands once in the corpus stand once and go no further. For all others, the hash
of the whole passage is compared, over all its occurrences: a place that isn't the least of its hash is a repeat. This is
the extension of a match both ways, word by word and against every occurrence at once: a run goes on as long as the next
passage is a repeat of any. Both steps are minima by hash, summed up before they are exchanged, so neither work nor a task's
rows grow with the pairs. Texts aren't exchanged for it, only the hashes of their words.

Whole lines would be the cheaper unit, but a passage of long sentences, or one that starts inside of a line, has no whole
line in common with its copy; so words are.

Defined cases: words are as in common.words, and the white space between them doesn't tell passages apart. A null text has no
word and stays null; an empty one stays empty. Rows with the same doc_id and text are one document and are treated alike:
they don't count as repeats of each other. Null doc_ids come last, ordered by their text's hash. Nothing is removed from a
text without a repeated passage, to the byte. n_runs and n_removed count the runs and words that go. Other columns are kept,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrow_words import text_slices, word_codes
from .common import aside, release, table, written

GRAM_WORDS, MIN_WORDS = 8, 25
#: Grams in a passage: with any more, a passage could have no fingerprint of its own.
WINDOW_WORDS = MIN_WORDS - GRAM_WORDS + 1

_WORDS = re.compile(r"[^ \t-\r]+").finditer
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A place is its task's number, shifted so far, and the number of words before it in the task.
_TASK_BITS = 40
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the offsets of the texts."""
    codes, at, distinct = word_codes(texts)
    h = np.fromiter(map(xxhash.xxh32_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint32, len(distinct))
    return h[codes], at


def _sums(h: np.ndarray) -> np.ndarray:
    """The sums of the mixed hashes of the words before each word, times powers of _R: those between two places tell their words."""
    global _powers
    if len(_powers[0]) < len(h):
        n = 1 << (len(h) - 1).bit_length()
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, r)))) for r in (_R, _R_INVERSE))
    x = (h.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= _powers[0][: len(x)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))


def _grams(sums: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on."""
    g = sums[n:] - sums[:-n]
    g *= _powers[1][: len(g)]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(29))


def _passages(sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start of each passage of the texts, the place of its fingerprint, and the hashes of all grams."""
    g = _grams(sums, GRAM_WORDS)
    size = len(sums) - 1
    n = max(0, size - MIN_WORDS + 1)
    low = np.uint64((1 << 28) - 1)  # the low bits give way to the place, so the leftmost of equal grams is the least
    least, span = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
    while span < WINDOW_WORDS:
        step = min(span, WINDOW_WORDS - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    starts = np.nonzero(np.arange(n) + MIN_WORDS <= np.repeat(at[1:], np.diff(at))[:n])[0]
    return starts, (least[starts] & low).astype(np.int64), g


def winnow(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and places of the fingerprints of texts."""
    if len(h) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, least, g = _passages(_sums(h), at)
    chosen = np.zeros(len(g), bool)
    chosen[least] = True
    places = np.nonzero(chosen)[0]
    return g[places].view(np.int64), places


def _lists(values: np.ndarray, places: np.ndarray, at: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    """The values as a list for each text; they stand at ascending places."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, at), pa.int32()), pa.array(values, type_))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each; a null is empty."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u is a number of the row, n its words."""
    row = TaskContext.get().partitionId() << _TASK_BITS
    for batch in batches:
        for part in text_slices(batch):
            h, at = _hashed(part.column("text"))
            prints, places = winnow(h, at)
            own = places - np.repeat(at[:-1], np.diff(np.searchsorted(places, at)))
            binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(h)])
            columns = [pa.array(np.arange(row, row + part.num_rows)), part.column("k"), part.column("t"), pa.array(np.diff(at), pa.int64()), binary, _lists(prints, places, at, pa.int64()), _lists(own, places, at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["u", "k", "t", "n", "words", "prints", "places"])
            row += part.num_rows


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; d is the place of the first word of each document. Of rows of one document only the first stays."""
    base, last = TaskContext.get().partitionId() << _TASK_BITS, None
    for batch in batches:
        k, t, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ktn")
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        if len(k):
            fresh[0] = last != (k[0], t[0])
            last = k[-1], t[-1]
        n = n[fresh]
        d = base + np.cumsum(n) - n
        base += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(fresh)), pa.array(d, pa.int64())], ["u", "d"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The starts and hashes of the passages of each document whose fingerprints aren't alone."""
    for batch in batches:
        for part in text_slices(batch, "words"):
            size = pc.binary_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            at = np.concatenate(([0], np.cumsum(size)))
            h = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint32)
            if len(h) < MIN_WORDS:
                continue
            sums = _sums(h)
            starts, least, _ = _passages(sums, at)
            place, row = _flat(part.column("alone"))
            alone = np.zeros(len(h), bool)
            alone[place + at[row]] = True
            starts = starts[~alone[least]]
            n = np.diff(np.searchsorted(starts, at))
            own = starts - np.repeat(at[:-1], n)
            new = np.ones(len(starts), bool)
            new[1:] = (np.diff(starts) > 1) | (own[1:] == 0)
            first = np.flatnonzero(new)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (own[first], np.diff([*first, len(starts)]))], ["a", "n"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts[first], at), pa.int32()), spans)
            columns = [*(part.column(c) for c in "ktd"), spans, _lists(_grams(sums, MIN_WORDS)[starts].view(np.int64), starts, at, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "t", "d", "spans", "hashes"]).filter(pa.array(n > 0))


def _starts(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The starts that each row's spans (a, and n from there on) stand for, and the row of each."""
    n = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
    a, m = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
    before = np.cumsum(m) - m
    return np.repeat(a - before, m) + np.arange(int(m.sum())), np.repeat(np.repeat(np.arange(len(n)), n), m)


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each passage that is asked for: its hash, its document's place and its own."""
    for batch in batches:
        for n in range(0, batch.num_rows, 512):
            part = batch.slice(n, 512)
            start, row = _starts(part.column("spans"))
            d = part.column("d").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([part.column("hashes").flatten(), pa.array(d), pa.array(d + start)], ["hash", "d", "at"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of words that the starts other than the first places of their passages make up."""
    for batch in batches:
        start, row = _starts(batch.column("spans"))
        first, of = _flat(batch.column("firsts"))
        x = start + (row << _TASK_BITS)
        x = x[~np.isin(x, first + (of << _TASK_BITS))]
        new = np.ones(len(x) + 1, bool)
        new[1:-1] = np.diff(x) > MIN_WORDS
        a, b = x[new[:-1]], x[new[1:]] + MIN_WORDS
        rows = np.arange(batch.num_rows + 1) << _TASK_BITS
        spans = pa.StructArray.from_arrays([pa.array(v & ((1 << _TASK_BITS) - 1), pa.int32()) for v in (a, b)], ["a", "b"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, rows), pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), runs], ["k", "t", "runs"]).filter(pc.greater(pc.list_value_length(runs), 0))


def _by_document(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key and the list of its places in rows (key, pos)."""
    return rows.groupBy(key).agg(F.collect_list("pos").alias(name))


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """k, t and runs, for the documents (k, t, text) that lose words; a run is from word a up to word b."""
    units = written(keyed.select("k", "t", "text").mapInArrow(_coded, "u long, k long, t long, n long, words binary, prints array<long>, places array<int>"), "words")
    seen = units.select("u", F.explode(F.arrays_zip("prints", "places")).alias("x")).select(F.col("x.prints").alias("print"), "u", F.col("x.places").alias("pos"))
    once = seen.groupBy("print").agg(F.min("u").alias("u"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")).where("n = 1")
    alone = written(_by_document(once, "u", "alone"), "alone")
    order = units.select("k", "t", "n", "u").repartitionByRange("k", "t").sortWithinPartitions("k", "t").mapInArrow(_placed, "u long, d long")
    asked = units.select("u", "k", "t", "words").join(alone, "u", "left").join(order, "u").select("k", "t", "d", "words", "alone")
    asked = written(asked.mapInArrow(_asked, "k long, t long, d long, spans array<struct<a: int, n: int>>, hashes array<long>"), "passages")
    release(units, alone)
    every = asked.select("d", "spans", "hashes").mapInArrow(_every, "hash long, d long, at long")
    first = every.groupBy("hash").agg(F.min("d").alias("d"), F.min("at").alias("at"))  # the document of the least place is the least
    first = first.select("d", (F.col("at") - F.col("d")).cast("int").alias("pos"))
    found = asked.select("k", "t", "d", "spans").join(_by_document(first, "d", "firsts"), "d", "left").select("k", "t", "spans", "firsts")
    runs = written(found.mapInArrow(_runs, "k long, t long, runs array<struct<a: int, b: int>>"), "runs")
    release(asked)
    return runs


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs, which are in order and don't touch."""
    spans = [m.span() for m in _WORDS(text)]
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    kept.append(text[at:])
    out = "".join(kept)
    return out.rstrip() if at == len(text) else out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text as it is without repeated passages, and n_runs and n_removed added."""
    keyed = aside(docs, ("text",))
    id_ = keyed[f"_c{docs.columns.index('doc_id')}"]
    keyed = keyed.withColumns({"k": F.coalesce(id_, F.lit(2**63 - 1)), "t": F.xxhash64("text")})
    joined = keyed.join(repeated_runs(keyed).hint("shuffle_hash"), ["k", "t"], "left").drop("k", "t")
    schema = StructType([*[StructField(f"_c{n}", f.dataType if f.name != "text" else StringType()) for n, f in enumerate(docs.schema.fields)], StructField("n_runs", LongType()), StructField("n_removed", LongType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                columns, runs = part.columns[:-1], part.column("runs")
                n = pc.fill_null(pc.list_value_length(runs), 0)
                some = pc.greater(n, 0)
                texts, of = part.column("text").filter(some).to_pylist(), runs.filter(some).to_pylist()
                cut = pa.array([without(x, [(r["a"], r["b"]) for r in rs]) for x, rs in zip(texts, of, strict=True)], pa.string())
                columns[at] = pc.replace_with_mask(part.column("text"), some, cut)
                gone = np.zeros(part.num_rows, np.int64)
                gone[some.to_numpy(zero_copy_only=False)] = [sum(r["b"] - r["a"] for r in rs) for rs in of]
                yield pa.RecordBatch.from_arrays([*columns, n.cast(pa.int64()), pa.array(gone)], schema.names)

    return joined.mapInArrow(run, schema).toDF(*docs.columns, "n_runs", "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
