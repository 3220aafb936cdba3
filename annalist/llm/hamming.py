"""Candidates that meet under keys, compared by Hamming distance; keys that very many share are made finer first."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Keys of more fingerprints than this are made finer.
HOT_KEY = 4096


def masks(radius: int) -> list[int]:
    """Of radius + 4 sets of bits (each holds every radius + 4-th), the unions of all choices of 4.

    Two values within the radius differ in at most radius sets, so they agree in all bits of some choice.
    """
    n = radius + 4
    own = [sum(1 << k for k in range(s, 64, n)) for s in range(n)]
    return [sum(c) for c in combinations(own, 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def meet(probe: DataFrame, index: DataFrame, radius: int, hot_key: int | None = None) -> DataFrame:
    """a, b and key for all rows of probe (a, key) and index (b, key) that share a key, with 1 to radius differing bits.

    Rows of a key that over hot_key rows of the index share meet only where they also agree in one of the ``masks``. This
    loses no pair, and splits such a key 2^(its free bits times 4 / (radius + 4)) ways, so they don't meet all with all.
    A pair that agrees in several masks comes several times.
    """
    hot = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (HOT_KEY if hot_key is None else hot_key)).select("key"), "hot")
    near = F.expr(f"a <> b and bit_count(a ^ b) <= {radius}")
    if hot.isEmpty():
        return probe.join(index, "key").where(near).select("a", "b", "key")
    cold = probe.join(hot, "key", "left_anti").join(index, "key")

    def finer(df: DataFrame, fp: str) -> DataFrame:
        each: list[Column] = [F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("part")) for t, m in enumerate(masks(radius))]
        return df.join(hot, "key", "left_semi").withColumn("x", F.explode(F.array(*each))).select(fp, "key", "x.t", "x.part")

    warm = finer(probe, "a").join(finer(index, "b"), ["key", "t", "part"])
    return cold.select("a", "b", "key").union(warm.select("a", "b", "key")).where(near)
