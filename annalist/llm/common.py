"""Helpers shared by the corpus operators: scratch tables and the white-space word rule."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is space, tab, line feed, vertical tab, form feed and carriage return; every other character is part of a word.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="annalist-scratch-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


#: Spark's switch for removing the shuffle files of a query once it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """In it, a query that has ended leaves no shuffle files. While it runs they are kept, for lost executors."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing of it.

    The table goes when the driver's JVM ends, or at once by ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/annalist-{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for t in tables:
        fs, p = _path(t.sparkSession, t._scratch)
        fs.delete(p, True)


def aside(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with its columns renamed by position, but for those in keep, so that no name clashes with one added later."""
    return df.toDF(*[c if c in keep else f"_c{n}" for n, c in enumerate(df.columns)])


def words(text: Column) -> Column:
    """The words of a text as an array, in order; empty for a null, empty or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
