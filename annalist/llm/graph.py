"""Distributed connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by randomised contraction.

    edges has the columns src and dst of one orderable type. Returns node and root, one row for each node that has an
    edge to another node; two nodes have the same root exactly when a path joins them. Which node is the root is
    arbitrary but fixed. Null ends, self loops and repeated edges are ignored; no edges give no rows.

    Each round, every node takes the least, by a hash that changes with the round, of itself and its neighbours; edges
    are renamed so, and those inside a group vanish. A constant share of the nodes goes in a round, whatever the
    diameter. Neighbours are reduced by a partial aggregate before they are shuffled, so no group is gathered in a task.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    e = written(e.union(e.select("dst", "src")).distinct(), "edges")
    label, n = None, 0
    while not e.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(n), F.col(c))
        near = e.groupBy("src").agg(F.min(F.struct(rank("dst").alias("r"), F.col("dst").alias("v"))).alias("m"))
        own = F.struct(rank("src").alias("r"), F.col("src").alias("v"))
        step = written(near.select(F.col("src").alias("node"), F.least("m", own)["v"].alias("root")), "roots")
        label = step if label is None else _follow(label, step)
        left = e.join(step.select(F.col("node").alias("src"), F.col("root").alias("a")), "src")
        both = left.join(step.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst")
        e = written(both.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges")
        n += 1
    if label is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return label


def _follow(label: DataFrame, step: DataFrame) -> DataFrame:
    """label with each root replaced by what step maps it to."""
    to = step.select(F.col("node").alias("root"), F.col("root").alias("then"))
    return label.join(to, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
