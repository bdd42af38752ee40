"""The model seam: order, retries, resume, refusal of what is missing."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import seam


def test_retries_until_all_have_a_text(spark):
    def flaky():
        calls = {"n": 0}

        def ask(prompts):
            calls["n"] += 1
            if calls["n"] % 2:
                raise TimeoutError
            return [None if i else p.upper() for i, p in enumerate(prompts)]

        return ask

    rows = spark.createDataFrame([(i, "p" * i) for i in range(1, 4)], "id long, prompt string").coalesce(1)
    out = seam.generated(rows, "prompt", "text", flaky, batch=3, tries=8, wait_s=0.0)
    assert {r.id: r.text for r in seam.complete(out, "text").collect()} == {1: "P", 2: "PP", 3: "PPP"}
    with pytest.raises(ValueError):
        seam.complete(seam.generated(rows, "prompt", "text", flaky, batch=3, tries=2, wait_s=0.0), "text")


def test_resume_and_policy(spark):
    rows, done = spark.range(5), spark.range(3)
    assert sorted(r.id for r in seam.resumed(rows, done, "id").collect()) == [3, 4]
    cases = spark.createDataFrame([(1, True, "high"), (2, False, "high"), (3, None, "high"), (4, False, "low")], "id long, ok boolean, need string")
    assert sorted(r.id for r in cases.where(seam.round_trip_kept(F.col("ok"), F.col("need"))).collect()) == [1, 3, 4]


def test_heartbeat(spark, tmp_path):
    from corpusmill.streaming import ingest

    beat = ingest.Heartbeat(spark)
    spark.range(3).write.parquet(f"{tmp_path}/in")
    ingest.run_to_parquet(spark, spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "beat")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert isinstance(beat.last(), dict)
