"""Queries without SQL read all rows of their table, not a range of keys."""

from pathlib import Path

from pyspark.sql import functions as F

from corpusmill.plans import code
from corpusmill.plans.registry import QUERIES


def test_stack_facts_stacks_every_function(spark, sf):
    larger = str(Path(sf).parent / "sf0.01")
    members = code.stacked(spark, larger).select(F.explode("members").alias("m")).select("m.id")
    assert sorted(r.id for r in members.collect()) == sorted(r.p_partkey for r in spark.read.parquet(f"{larger}/part.parquet").collect())
    assert QUERIES["stack_facts"](spark, larger).select("stack").distinct().count() == code.stacked(spark, larger).count()
