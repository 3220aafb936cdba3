"""The corpus pipeline: quality filter, line dedup, near dedup, mixing, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import aside, table, written
from annalist.llm.line_dedup import dedup_lines
from annalist.llm.mixing import mix
from annalist.llm.near_dedup import deduplicate
from annalist.llm.packing import default_tokenizer, pack
from annalist.llm.quality import filter_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, unchanged."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that stand in an earlier one; those of which nothing is left go. n_chars follows."""
    own = aside(docs, ("doc_id", "text"))
    d = dedup_lines(own).where("n_removed = 0 or text <> ''")
    n_chars = F.char_length("text").cast("long")
    columns = [F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col(x)).alias(x) if c == "n_chars" else F.col(x) for c, x in zip(docs.columns, own.columns, strict=True)]
    return d.select(*columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in slot order: documents of scarce sources come up to three times, those of plentiful ones in part."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, default_tokenizer())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: No stage but the last can be told from its input by SQL (hash features, SimHash, a tokenizer), so tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
