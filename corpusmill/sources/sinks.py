"""Sinks: rolling JSONL, partitioned Parquet, declared datasets, shard pairs, rejects, atomic publishing, frozen files, reports."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import file_system, remove

#: The declared corpus schema.
CORPUS = (
    "repo string, path string, func_name string, code string, n_tokens long, qualified string, span array<long>, is_method boolean, is_async boolean, decorated boolean, "
    "has_docstring boolean, typed boolean, string_share double, n_strings int, source string, file_ts long, commit_id string, repo_created string"
)


def rolling_json(rows: DataFrame, path: str, per_file: int = 50_000, compression: str = "none") -> None:
    """At most per_file rows a shard; earlier shards of the path go first, so none is stale."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression).json(path)


def partitioned(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def corpus_dataset(rows: DataFrame, path: str) -> None:
    """Train and validation under the declared schema, partitioned by split."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(CORPUS).fields
    rows.select(*[F.col(f.name).cast(f.dataType) for f in fields], "split").write.mode("overwrite").partitionBy("split").parquet(path)


def shard_pair(rows: DataFrame, path: str, record: list[str], meta: list[str], key: str) -> None:
    """Records and provenance side by side under one key, from one frame."""
    rows.select(key, *record).write.mode("overwrite").json(f"{path}/pairs")
    rows.select(key, *meta).write.mode("overwrite").json(f"{path}/meta")


def rejects(rows: DataFrame, path: str, kept: tuple[str, ...]) -> None:
    """Every dropped row once, with its one reason, as gzip JSON."""
    rows.where(~F.col("status").isin(*kept)).select("id", "pile", F.col("status").alias("reason")).write.mode("overwrite").option("compression", "gzip").json(path)


def publish(spark: SparkSession, rows: DataFrame, path: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Write aside, run checks that must find no violating row, then rename into place.

    What was published before steps aside by a rename and goes only when the new one is in place; a failure brings it back and
    leaves nothing else. A former publisher that died between its two renames is put right first.
    """
    aside, before = f"{path}.new", f"{path}.old"
    system, target = file_system(spark, path)
    old = file_system(spark, before)[1]
    if system.exists(old) and not system.exists(target):
        system.rename(old, target)
    remove(spark, before)
    remove(spark, aside)
    try:
        rows.write.parquet(aside)
        written = spark.read.parquet(aside)
        if written.isEmpty():
            raise ValueError("nothing to publish")
        if bad := [name for name, check in checks.items() if not check(written).isEmpty()]:
            raise ValueError(f"checks failed: {bad}")
        if system.exists(target) and not system.rename(target, old):
            raise OSError(f"cannot move {path} aside")
        if not system.rename(file_system(spark, aside)[1], target):
            system.rename(old, target)
            raise OSError(f"cannot rename {aside}")
        remove(spark, before)
    except Exception:
        remove(spark, aside)
        raise


def frozen_bytes(rows: DataFrame, order: str) -> bytes:
    """A small result as deterministic gzip JSONL: ordered rows, sorted keys, no time stamp."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
        for r in rows.orderBy(order).toLocalIterator():
            f.write((json.dumps(r.asDict(recursive=True), sort_keys=True, ensure_ascii=False) + "\n").encode())
    return out.getvalue()


def freeze(rows: DataFrame, path: str, order: str, check: bool = False) -> bool:
    """Write once; never overwrite. With check: whether the file is what would be written now."""
    from pathlib import Path

    data, file = frozen_bytes(rows, order), Path(path)
    if check:
        return file.exists() and file.read_bytes() == data
    if file.exists():
        raise FileExistsError(path)
    file.write_bytes(data)
    return True


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of aggregate frames (small by construction)."""
    out = [f"# {title}"]
    for name, frame in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + " - |" * len(frame.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in frame.collect()]
    return "\n".join(out) + "\n"
