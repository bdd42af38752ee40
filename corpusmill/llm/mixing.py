"""Mixing sources to target weights by capped water-filling (DataFrame and SQL functions only).

Sources share a word budget in proportion to their weights. A source whose share would exceed its
cap (a number of epochs times its size) is clamped there and the excess goes to the others by weight
until nothing exceeds its cap. That fixpoint is min(cap, level * weight) for one water level, found
from one sort of the sources by cap / weight. A target of r epochs takes every document floor(r)
times, and once more the documents that come first in a seeded hash order, up to the fraction.

Scale: documents are summed into (source, hash prefix) cells before any shuffle, so a source with a
third of all rows is 4096 cells; only the one cell per source in which the fraction ends is ordered.
The outcome per source is one cut key, so documents get their decision by a join with one row per
source and are never sorted, collected or shuffled by source.

Null text has size 0 and null source is a source of its own, the last. Sizes of 0 take 0. Rows that
share a doc_id share a hash key, so they are taken together. Very long texts are counted whole. Empty tables give
empty results. The columns that are added replace a caller's of the same name; no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, word_count  # noqa: F401

WEIGHTS = (3, 1, 2)
CELL_DIGITS = 3


def hash_key(seed: str, doc_id: str = "doc_id") -> Column:
    """Seeded order of documents: hex, so that its prefix is the cell."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with weight and target. One row per source is all that is sorted here."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("filled", F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("level", (F.lit(share) * F.col("all_size") - F.lit(epochs) * F.col("filled")) / F.col("open_weight"))
        .withColumn("water", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(spark: SparkSession, slim: DataFrame, weights: tuple[int, ...], share: float, epochs: float) -> DataFrame:
    """One row per source: target, whole repetitions, and the cell and key where the fractional one ends.

    slim: doc_key, source, size, on storage (it is read twice).
    """
    cell = F.substring("doc_key", 1, CELL_DIGITS)
    cells = slim.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("cell_size"))
    cells = stored(spark, cells, "mix-cells")
    targets = water_fill(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, epochs)
    epochs_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epochs_of)).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(spark, targets, "mix-targets")
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).alias("c")
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    last = (
        placed.join(targets.alias("t"), same)
        .where((F.col("before") < F.col("more")) & (F.col("before") + F.col("cell_size") >= F.col("more")))
        .select("c.source", "cell", "before", "more")
    )
    inside = Window.partitionBy("source", "cell").orderBy("doc_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        slim.withColumn("cell", cell).alias("d")
        .join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.cell") == F.col("l.cell")))
        .select("d.source", "d.cell", "d.doc_key", "d.size", "l.before", "l.more")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .groupBy("source", "cell")
        .agg(F.max(F.when(2 * F.col("start") + F.col("size") < 2 * F.col("more"), F.col("doc_key"))).alias("last_key"))
    )
    plan = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    return stored(spark, plan.select(F.col("t.source").alias("plan_source"), "t.source_size", "t.target", "t.whole", "t.more", F.col("e.cell").alias("last_cell"), "e.last_key"), "mix-plan")


def with_taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds _mix_source_size, _mix_target, _mix_repeats and _mix_taken to rows with source, _mix_size and _mix_key."""
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    col = lambda name: F.col(f"_mix_{name}")
    cell = F.substring("_mix_key", 1, CELL_DIGITS)
    # without a last cell the fraction is empty, or it is the whole source by rounding
    extra = F.when(col("last_cell").isNull(), col("more") >= col("source_size")).otherwise(
        (cell < col("last_cell")) | ((cell == col("last_cell")) & F.coalesce(col("key") <= col("last_key"), F.lit(False)))
    )
    joined = docs.join(plan, F.col("source").eqNullSafe(col("plan_source")))
    repeats = col("whole") + F.when((col("more") > 0) & extra, 1).otherwise(0)
    return joined.withColumn("_mix_repeats", repeats.cast("long")).withColumn("_mix_taken", (col("repeats") * col("size")).cast("long"))


def _named(rows: DataFrame, columns: list[str], added: tuple[str, ...]) -> DataFrame:
    """Own columns of the rows, then the mix's; of the same name (in any case) the mix's."""
    own = [c for c in columns if c.lower() not in added]
    return rows.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"_mix_{c}").alias(c) for c in added])


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken for every document."""
    slim = stored(spark, docs.select("doc_id", "source", word_count().alias("size"), hash_key(seed).alias("doc_key")), "mix-slim")
    plan = mix_plan(spark, slim, weights, share, epochs)
    taken = with_taken(slim.withColumnsRenamed({"size": "_mix_size", "doc_key": "_mix_key"}), plan)
    return _named(taken, ["doc_id", "source"], ("size", "source_size", "target", "repeats", "taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents the mix takes, whole, each with size, source_size, target, repeats and taken; those it doesn't take are gone.

    Other columns stay as they are; a column of docs with one of those five names is replaced.
    """
    sized = docs.withColumn("_mix_size", word_count()).withColumn("_mix_key", hash_key(seed))
    slim = stored(spark, sized.select("source", F.col("_mix_size").alias("size"), F.col("_mix_key").alias("doc_key")), "mix-slim")
    taken = with_taken(sized, mix_plan(spark, slim, weights, share, epochs)).where("_mix_repeats > 0")
    return _named(taken, docs.columns, ("size", "source_size", "target", "repeats", "taken"))
