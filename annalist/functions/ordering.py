"""Numbering and folding in a total order without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

RUN = 65_536


def global_number(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 1 in the order of key (a bigint) and then order.

    Rows are numbered inside runs of RUN keys; only a count for each run is summed over all.
    """
    d = df.withColumn("_run", F.expr(f"{key} div {RUN}"))
    n = d.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_run", F.coalesce(F.sum("_n").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy("_run").orderBy(key, *order)))
    return d.join(n, "_run").withColumn(name, (F.col("_in") + F.col("_base")).cast("long")).drop("_run", "_in", "_base")


def folded(df: DataFrame, group: str, order: list[str], size: str, budget: int, most: int | None = None, first_always: bool = False) -> DataFrame:
    """df with admitted: in order, a row is admitted if its size and number still fit with those admitted before in its group.

    first_always admits a row while nothing is. A group's rows are sorted and stream by, and only two numbers are kept.
    """
    schema = StructType([*df.schema.fields, StructField("admitted", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n = (), 0, 0
        for batch in batches:
            out = []
            for g, x in zip(batch.column(group).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if (g,) != now:
                    now, used, n = (g,), 0, 0
                ok = x is not None and (first_always and not used or used + x <= budget) and (most is None or n < most)
                if ok:
                    used, n = used + x, n + 1
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], schema.names)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def greedy_budget(df: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """df with admitted: in order, a row is admitted unless something is already and its size would overflow the budget."""
    return folded(df, group, order, size, budget, first_always=True)


def prefix_budget(df: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """df with admitted: the longest prefix in order within the budget; the first row always belongs to it."""
    w = W.partitionBy(group).orderBy(*order)
    upto = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    stop = (upto - F.col(size) > 0) & (upto > budget)
    d = df.withColumn("_stop", stop.cast("int"))
    return d.withColumn("admitted", F.max("_stop").over(w.rowsBetween(W.unboundedPreceding, 0)) == 0).drop("_stop")
