"""Structured Streaming forms of resumable ingest: dedup, repo caps, ledgers, windows.

Every query runs with availableNow on a file source and a checkpoint in the shared folder, so it can be
stopped and started again; state lives in the state store, never in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.sources.storage import file_system, scratch


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = 1) -> DataFrame:
    """A table of the input folder, one file or a folder of them, as a stream; new files are new rows. None: all that is there is one batch."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    system, target = file_system(spark, path)
    if system.getFileStatus(target).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_parquet(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """All that is there now, to Parquet; the same checkpoint and output continue where they stopped."""
    out, checkpoint = out or scratch(spark, name), checkpoint or scratch(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def seen_hashes(stream: DataFrame, *within: str) -> DataFrame:
    """The first row of each content hash (of each value of the columns within) over the life of the stream."""
    return stream.withColumn("h", C.content_hash("text")).dropDuplicates([*within, "h"])


def capped_repos(stream: DataFrame, key: str, cap: int) -> DataFrame:
    """Up to cap rows of each key over the life of the stream, first come first kept (in order of doc_id within a batch).

    A key's rows of a batch come in frames, of which only the smallest that the cap still has room for are held; a full key's
    are not looked at. The state is a count, so a query that is stopped and started again keeps the cap.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def keep(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        if had < cap:
            held = None
            for frame in frames:
                held = (frame if held is None else pd.concat([held, frame])).nsmallest(cap - had, "doc_id")
            if held is not None:
                state.update((had + len(held),))
                yield held

    slim = stream.select("doc_id", key)
    return slim.groupBy(key).applyInPandasWithState(keep, slim.schema, "n long", "append", GroupStateTimeout.NoTimeout)


def with_ledger(spark: SparkSession, stream: DataFrame, done: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Idempotent batches: rows whose key an earlier batch finished are skipped; a batch that is run again writes its own folder again.

    The ledger is state by key, in the checkpoint: a batch looks up its own keys and reads nothing that earlier batches wrote. Spark gives
    a batch that it runs again the same rows and the state from before it. A batch gets its rows and, from the state, those of its
    keys that are new; the rows that go on are those with a new key, all of them.
    """
    new = stream.select(key).dropDuplicates([key]).withColumn("_new", F.lit(True))
    both = stream.withColumn("_new", F.lit(False)).unionByName(new, allowMissingColumns=True)

    def batch(frame: DataFrame, batch_id: int) -> None:
        fresh = frame.withColumn("_fresh", F.max("_new").over(Window.partitionBy(key))).where("_fresh AND NOT _new").drop("_fresh", "_new")
        work(fresh).write.mode("overwrite").parquet(f"{done}/batch={batch_id}")

    both.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def valid_prefix(lines: DataFrame, order: str = "line") -> DataFrame:
    """Receipts up to the first torn line: what a resumed run may trust."""
    bad = lines.where(F.json_object_keys("value").isNull()).agg(F.min(order).alias("_bad"))
    return lines.join(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def windowed_counts(stream: DataFrame, ts: str, by: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per event-time window; windows close when the watermark has passed them."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", window).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")


class Heartbeat:
    """Progress of running queries as a listener; last() is the newest progress of each."""

    def __init__(self, spark: SparkSession):
        from pyspark.sql.streaming import StreamingQueryListener

        latest: dict[str, dict] = {}

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):  # noqa: N802
                pass

            def onQueryProgress(self, event):  # noqa: N802
                p = event.progress
                latest[str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows}

            def onQueryIdle(self, event):  # noqa: N802
                pass

            def onQueryTerminated(self, event):  # noqa: N802
                pass

        self._latest, self._listener = latest, Listener()
        spark.streams.addListener(self._listener)

    def last(self) -> dict[str, dict]:
        return dict(self._latest)
