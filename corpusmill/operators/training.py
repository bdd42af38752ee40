"""Trainer data plane: rarity, span masses, loss weights, telemetry, pooling of vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.storage import stored


def rarity(tokens: DataFrame, rare_below: float = 1e-5) -> DataFrame:
    """token, n, rarity (surprisal, min-max scaled) and is_rare. The scale is one row, joined as such."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    scale = counts.agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("total"))
    spread = F.greatest(F.ln("hi") - F.ln("lo"), F.lit(1e-12))
    return counts.join(F.broadcast(scale)).select("token", "n", ((F.ln("hi") - F.ln("n")) / spread).alias("rarity"), (F.col("n") < rare_below * F.col("total")).alias("is_rare"))


def span_masses(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mass per span of the tokens that overlap it. Both sides share doc_id; overlap is the residual."""
    joined = spans.join(tokens, "doc_id").where((F.col("a") < F.col("end")) & (F.col("b") > F.col("start")))
    return joined.groupBy("doc_id", "kind").agg(F.sum("mass").alias("mass"))


def loss_weight(prose: Column, rare: Column, margin: Column, weights: tuple[int, int, int, int] = (1, 8, 4, 2)) -> Column:
    """Prose overrides all; then rare, then margin, then plain."""
    p, r, m, plain = weights
    return F.when(prose, p).when(rare, r).when(margin, m).otherwise(plain)


def telemetry_trim(lines: DataFrame, resume: int) -> DataFrame:
    """Complete JSON lines up to the resume step; lines without a step stay."""
    step = F.get_json_object("value", "$.step").cast("long")
    return lines.where(F.json_object_keys("value").isNotNull() & (step.isNull() | (step <= resume)))


def ema(rows: DataFrame, key: str, value: str, order: list[str], keep: float) -> DataFrame:
    """Exponential mean over a key's values in order, a fold in the JVM."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    fold = F.aggregate(F.slice("_v", 2, 1 << 30), F.element_at("_v", 1), lambda a, x: a * keep + x * (1 - keep))
    return rows.groupBy(key).agg(ordered.alias("_v")).select(key, fold.alias("ema"))


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A map of counts per key, counted before it is gathered."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(value, "_n"))).alias("hist"))


def pool_mean(vector: Column, pf: int) -> Column:
    """Means of consecutive groups of pf; a short last group by its own length."""
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vector) / pf).cast("int") - 1, F.lit(0)))
    part = lambda g: F.slice(vector, g * pf + 1, F.lit(pf))
    return F.transform(groups, lambda g: F.aggregate(part(g), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(part(g)))


def rotate(vector: Column, pairs: int, period: float) -> Column:
    """First component of each pair after a rotation by pair / period."""
    at = lambda i: F.get(vector, i).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(pairs - 1)), lambda i: at(2 * i) * F.cos(i / period) - at(2 * i + 1) * F.sin(i / period))


def softmax_pool(vector: Column) -> Column:
    """Mean of a vector under its own softmax."""
    total = lambda f: F.aggregate(vector, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return total(lambda x: F.exp(x) * x) / total(lambda x: F.exp(x))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rarest(spark: SparkSession, texts: DataFrame, counts: DataFrame, known: int = 100_000) -> DataFrame:
    """doc_id, pos, token: of each text's tokens ([a-z]+, places from 1) the tenth with the least counts, ties to the later one.

    Tasks know the `known` largest counts. All other tokens are rarer, so a text that has no more of those than its tenth is settled where it is
    read; of any other text only those tokens meet their counts. The parameter doesn't change the result. Each doc_id is one row.
    """
    top = counts.orderBy(F.desc("n")).limit(known + 1).collect()
    least = top[-1]["n"] if len(top) > known else 0
    common = {r["token"]: r["n"] for r in top if r["n"] > least}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = re.findall("[a-z]+", text or "")
                tenth = len(found) // 10
                ns = [common.get(token, 0) for token in found]
                if ns.count(0) > tenth:
                    rows += [(doc_id, i + 1, found[i], tenth) for i, n in enumerate(ns) if not n and tenth]
                else:
                    rows += [(doc_id, i + 1, found[i], None) for i in sorted(range(len(ns)), key=lambda i: (ns[i] << 40) - i)[:tenth]]
            kinds = (batch.schema.types[0], pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "pos", "token", "tenth"])

    placed = stored(spark, texts.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, token string, tenth int"), "rarest")
    w = Window.partitionBy("doc_id").orderBy("n", F.desc("pos"))
    ranked = placed.where("tenth IS NOT NULL").join(counts, "token").withColumn("rn", F.row_number().over(w)).where("rn <= tenth")
    return placed.where("tenth IS NULL").select("doc_id", "pos", "token").union(ranked.select("doc_id", "pos", "token"))
