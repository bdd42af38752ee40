"""What the operators of this subpackage share: words, the shared folder, cut lineage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.storage import passing, remove, scratch, shared_dir, stored  # noqa: F401

#: A word is a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    """The words of a text in order; null has none."""
    return WORD_RE.findall(text) if text else []


def word_count(column: str = "text"):
    """Number of words as a JVM expression (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, pruned to some columns."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete stored frames that nothing will read again."""
    for frame in frames:
        remove(spark, frame.stored_at)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not at the driver's next full collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
