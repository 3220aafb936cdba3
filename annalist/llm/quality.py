"""Operator 6, quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are words, pairs of words, the shapes of both (runs of capitals, small letters and digits become one sign), and
whether a word repeats the one before, hashed into 2^BITS places; a feature's value is its frequency among the text's
words. The model learns from at most ``train_rows`` labelled documents (a documented bound: those with the least XXH64 of
their doc_id). Scoring is a sparse dot product for every document, over its whole text, without a shuffle.

Defined cases: a null, empty or blank text has no feature; its score is that of the bias. Labels that are null, other than
0 and 1, or without a document teach nothing; of a doc_id's several labels the mean counts, a tie as 1; of its several
texts the least. Without a label of both kinds the score is the smoothed share of label 1 (0.5 with none). Repeated
rows give repeated rows; a null doc_id is not held out. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .arrow_words import segment_sums, text_slices, word_codes
from .common import table

BITS = 18
TRAIN_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 1e-4, 1e-3
THRESHOLD = 0.7
SCALE = 8.0


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed features of all words of all texts, an array for each kind, and the texts' offsets in each array."""
    codes, offsets, words = word_codes(texts)
    shape = words
    for pattern, sign in ((r"\p{Lu}+", "X"), (r"[\p{Ll}\p{Lo}]+", "x"), (r"\p{N}+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    kinds = shape.dictionary_encode()
    h = _hashes(words)[codes]
    s = _hashes(kinds.dictionary)[kinds.indices.to_numpy(zero_copy_only=False)][codes] if len(words) else h
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    before = lambda x: np.where(first, np.uint64(1), np.concatenate((x[:1], x[:-1])))
    same = np.where(first, 2, np.concatenate((codes[:1], codes[:-1])) == codes).astype(np.uint64)
    kinds_of = [h, _mix(before(h), h, 1), _mix(np.uint64(5), s, 2), _mix(before(s), s, 3), _mix(np.uint64(7), same, 4)]
    return [(x >> np.uint64(64 - BITS)).astype(np.int32) for x in kinds_of], offsets


def _hashes(words: pa.Array) -> np.ndarray:
    x = np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    return x * np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray | np.uint64, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(salt * 0x51ED2701)) * np.uint64(0xC2B2AE3D27D4EB4F) + b
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            kinds, offsets = features(part.column("text"))
            index, value = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                i, n = np.unique(np.concatenate([k[a:b] for k in kinds]), return_counts=True)
                index.append(i.astype("<i4").tobytes())
                value.append((n * (SCALE / max(1, b - a))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("label"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["rank", "label", "places", "counts"])


class Ftrl:
    """Follow-the-regularised-leader with a learning rate of its own for each weight; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, learned from at most train_rows labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    some = one.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(train_rows)
    text = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label", "rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = text.select("rank", "label", "text").mapInArrow(_rows, "rank long, label double, places binary, counts binary").collect()
    model = Ftrl(1 << BITS)
    labels_seen = {r.label for r in rows}
    if len(labels_seen) < 2:
        w = np.zeros((1 << BITS) + 1)
        w[-1] = np.log((sum(r.label for r in rows) + 1) / (sum(1 - r.label for r in rows) + 1))
        return w.astype(np.float32)
    data = [(np.append(np.frombuffer(r.places, "<i4"), 1 << BITS), np.append(np.frombuffer(r.counts, "<f4"), 1.0).astype(np.float64), r.label) for r in sorted(rows, key=lambda r: (r.rank, bytes(r.places)))]
    for _ in range(EPOCHS):
        for i, x, label in data:
            model.learn(i, x, label)
    return model.weights().astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                kinds, offsets = features(part.column("text"))
                each = sum(weights[k] for k in kinds) if len(kinds[0]) else np.zeros(0)
                n = np.maximum(1, np.diff(offsets))
                s = 1 / (1 + np.exp(-np.clip(weights[-1] + segment_sums(each, offsets) * SCALE / n, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    named = docs.toDF(*[c if c in ("doc_id", "text") else f"_c{n}" for n, c in enumerate(docs.columns)])
    return scored(named, train(docs.select("doc_id", "text"), labels)).where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
