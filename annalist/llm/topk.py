"""Operator 1, exact top-k inner-product search with block-at-a-time pruning.

Vectors become integers, and ranges of vec_id become blocks: a block has a forward index (its vectors as a matrix) and the
maximum and minimum of each term (component). A block's bound for a query is the sum over the terms of the largest product
with the query's component. For each query, blocks are taken in descending order of bounds and scored through their forward
index, until no bound that is left reaches the query's k-th score so far; ties with it are still scored. The result is exact.

Groups of blocks meet chunks of queries by an equi-join on the group's number. A row then holds one group and one chunk, both
of bounded size, so memory doesn't grow with the table; each pair yields k rows a query at most, and the k best of those stay.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without vec_id. A
shorter vector counts as padded with zeros, an empty one as zero. Repeated rows are candidates each; a query's own are all
rows with its vec_id, and a repeated query id asks once, with its least vector. Scores beyond a long stop at its ends.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

K = 10
BLOCK_ROWS, GROUP_ROWS, CHUNK_ROWS = 256, 8192, 512
#: Groups that one task of a large table makes.
TASK_GROUPS = 64


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(1024 x), for the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False))
    return vectors.where(good).select("vec_id", F.transform(x, lambda e: F.floor(F.greatest(F.least(e * 1024, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long")).alias("v"))


def _matrix(vs: list, dim: int | None = None) -> np.ndarray:
    dim = max((len(v) for v in vs), default=0) if dim is None else dim
    out = np.zeros((len(vs), dim), np.int64)
    for row, v in zip(out, vs, strict=True):
        row[: len(v)] = v
    return out


def _packed(rows_each: int, name: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        vs: list = []

        def out(n: int) -> pd.DataFrame:
            m = _matrix(vs[:n])
            row = {name: [np.asarray(ids[:n], np.int64).tobytes()], "m": [m.tobytes()], "dim": [m.shape[1]]}
            del ids[:n], vs[:n]
            return pd.DataFrame(row)

        for f in frames:
            ids += f.vec_id.tolist()
            vs += f.v.tolist()
            while len(ids) >= rows_each:
                yield out(rows_each)
        if ids:
            yield out(len(ids))

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T in whole numbers: by floats where they are exact, else by Python's integers, stopped at the ends of a long."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, at least the largest product, rounding allowed for."""
    q, high, low = q.astype(np.float64), high.astype(np.float64), low.astype(np.float64)
    b = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    slack = np.maximum(1, (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * 1e-12)
    return b + slack


def search_pair(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: dict[int, int], block_rows: int = BLOCK_ROWS) -> tuple[list, int]:
    """The k best of a group for each query, as (query_id, vec_id, score), and the number of block scorings.

    floor has a lower bound of each query's k-th score from other groups, and is raised.
    """
    dim = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, x))
    starts = range(0, len(x), block_rows)
    high = np.array([x[a : a + block_rows].max(0) for a in starts]).reshape(-1, dim)
    low = np.array([x[a : a + block_rows].min(0) for a in starts]).reshape(-1, dim)
    bounds = _bounds(q, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    need = np.array([floor.get(int(i), -(2**63)) for i in q_ids], np.float64)
    live, scored = np.arange(len(q_ids)), 0
    for step in range(len(bounds[0]) if len(q_ids) else 0):
        live = live[bounds[live, order[live, step]] >= need[live]]
        if not len(live):
            break
        at = order[live, step]
        for b in np.unique(at):
            who = live[at == b]
            a = int(b) * block_rows
            scores, part = _products(q[who], x[a : a + block_rows]), ids[a : a + block_rows]
            scored += len(who)
            for n, s in zip(who, scores, strict=True):
                other = part != q_ids[n]
                if not other.all():
                    s, cand = s[other], part[other]
                else:
                    cand = part
                s, cand = np.concatenate((best[n][0], s)), np.concatenate((best[n][1], cand))
                if len(s) > k:
                    top = np.lexsort((cand, -s))[:k] if len(s) < 4 * k else _top(s, cand, k)
                    s, cand = s[top], cand[top]
                best[n] = s, cand
                if len(s) == k:
                    need[n] = max(need[n], float(s.min()))
    out = []
    for n, i in enumerate(q_ids):
        if len(best[n][0]) == k:
            floor[int(i)] = max(floor.get(int(i), -(2**63)), int(best[n][0].min()))
        out += [(int(i), int(c), int(s)) for s, c in zip(*best[n], strict=True)]
    return out, scored


def _top(s: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
    kth = np.partition(s, len(s) - k)[len(s) - k]
    some = np.nonzero(s >= kth)[0]
    return some[np.lexsort((cand[some], -s[some]))[:k]]


def _searched(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor: dict[int, int] = {}
        for f in frames:
            for r in f.itertuples():
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q = np.frombuffer(r.qm, np.int64).reshape(len(q_ids), r.q_dim)
                x = np.frombuffer(r.m, np.int64).reshape(len(ids), r.dim)
                if len(floor) > 64 * CHUNK_ROWS:
                    floor.clear()
                found, _ = search_pair(q_ids, q, ids, x, k, floor)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score; vectors and queries have vec_id and v."""
    n = vectors.count()
    tasks = max(1, -(-n // (TASK_GROUPS * GROUP_ROWS)), min(-(-n // GROUP_ROWS), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = vectors.repartitionByRange(tasks, "vec_id").sortWithinPartitions("vec_id", "v")
    index = written(ordered.mapInPandas(_packed(GROUP_ROWS, "ids"), "ids binary, m binary, dim int").select(F.monotonically_increasing_id().alias("group"), "*"), "index")
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = one.mapInPandas(_packed(CHUNK_ROWS, "q_ids"), "q_ids binary, m binary, dim int")
    chunks = written(chunks.select("q_ids", F.col("m").alias("qm"), F.col("dim").alias("q_dim"), F.lit(1).alias("all")), "queries")
    numbers = index.groupBy(F.expr("group div 1000000").alias("part")).agg(F.collect_list("group").alias("groups")).select("groups", F.lit(1).alias("all"))
    each = chunks.join(numbers, "all").select("q_ids", "qm", "q_dim", F.explode("groups").alias("group"))
    met = each.join(index, "group")
    found = met.select("q_ids", "qm", "q_dim", "ids", "m", "dim").mapInPandas(_searched(k), "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v d ON q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
