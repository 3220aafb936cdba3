"""Bit votes of 64-bit hashes, in whole-stage code: 64 counters are kept as two 32-bit halves of 32 long sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = 0x0000000100000001


def vote(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """Per group of keys, the 64-bit majority fp of all elements of the array column hashes, and m, its number of rows.

    A bit is 1 if it is set in over half the elements. Null or empty arrays cast no vote; a group without any gets 0.
    The arrays are exploded and summed before the shuffle, so a group sends one row from each task, however large it is.
    """
    each = df.select(*keys, F.posexplode_outer(hashes).alias("p", "h"))
    sums = [F.sum(F.expr(f"shiftrightunsigned(h, {k}) & {_PAIR}L")).alias(f"s{k}") for k in range(32)]
    total = each.groupBy(*keys).agg(F.count("h").alias("n_votes"), F.sum(F.expr("if(p > 0, 0L, 1L)")).alias("m"), *sums)
    low = [F.when(F.expr(f"2 * (s{k} & 4294967295L) > n_votes"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(32)]
    high = [F.when(F.expr(f"2 * shiftrightunsigned(s{k}, 32) > n_votes"), F.lit(_signed(1 << k + 32))).otherwise(F.lit(0)) for k in range(32)]
    bits = reduce(lambda x, y: x.bitwiseOR(y), [c.cast("long") for c in low + high])
    return total.select(*keys, bits.alias("fp"), "m")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
