"""Streaming queries: what a stream makes of the tables equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.sources.storage import scratch
from corpusmill.streaming import ingest as I

from .registry import query


@query("stream_dedup_counts", r"SELECT lang, count(*) AS n FROM (SELECT DISTINCT lang, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS h FROM documents) GROUP BY lang")
def stream_dedup_counts(spark, sf):
    stream = I.seen_hashes(I.file_stream(spark, sf, "documents"), "lang").select("doc_id", "lang", "h")
    return I.run_to_parquet(spark, stream, "stream-dedup").groupBy("lang").agg(F.count("*").alias("n"))


@query("stream_repo_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 30")
def stream_repo_cap(spark, sf):
    """All files are one batch: the cap keeps the first documents of the table, not of the file that comes first."""
    return I.run_to_parquet(spark, I.capped_repos(I.file_stream(spark, sf, "documents", None), "source", 30), "stream-cap")


@query("stream_ledger", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_ledger(spark, sf):
    done, checkpoint = scratch(spark, "ledger"), scratch(spark, "ledger-checkpoint")
    for _ in range(2):  # the second run finds nothing left to do
        I.with_ledger(spark, I.file_stream(spark, sf, "events"), done, "event_id", lambda f: f.select("event_id", "event_type"), checkpoint)
    return spark.read.parquet(done).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_windows", "SELECT event_type, sum(n)::BIGINT AS n, count(*) AS windows FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def stream_windows(spark, sf):
    stream = I.windowed_counts(I.file_stream(spark, sf, "events"), "ts", "event_type")
    name = "windows_" + scratch(spark, "w").rpartition("-")[2]
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "windows-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))


@query("resume_prefix", "SELECT event_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id >= 500 AND event_id % 17 = 0)")
def resume_prefix(spark, sf):
    torn = F.when((F.col("event_id") >= 500) & (F.col("event_id") % 17 == 0), F.lit('{"torn')).otherwise(F.lit('{"a": 1}'))
    lines = spark.read.parquet(f"{sf}/events.parquet").select("event_id", torn.alias("value"))
    return I.valid_prefix(lines, "event_id").select("event_id")
