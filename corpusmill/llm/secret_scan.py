"""Secret scans by character Markov models (DataFrame and SQL functions only).

Base rules find assignments, access keys and hexadecimal strings. What they miss is found by likelihood: two Markov
chains over characters, one of random strings and one of ordinary identifiers, each trained from labelled samples. A maximal run
of TOKEN characters is a secret if the log-likelihood ratio of the chains, with that of their ends, exceeds `limit`.

Labelled samples: ordinary identifiers are the runs of TOKEN characters in a bounded sample of documents (SAMPLE_DOCS, the
smallest by a hash of doc_id and text), as they are and in upper case, without the spans of the base rules. Random strings are those spans'
values and SAMPLE_RANDOM strings of each of a few alphabets, made from digests. The models are 69 x 69 counts of pairs,
the same for every corpus size; they reach the driver and go back as one literal array. Every document is scanned whole.

Spans: a pattern with a lazy lead cuts a text into (gap, match) segments in one pass, whose lengths add up to the
positions, in code points. Matches are leftmost and do not overlap within a kind; a span is the whole match, from the keyword to the
value for assignments. Runs that touch a base span aren't scored.

Null and empty texts have no spans. Very long texts are read whole, in time in proportion. Repeated rows each get their own result.
An empty table gives an empty one (the chains are then those of random strings alone). Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

KINDS = ("assign", "access", "hex", "random")
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE, ACCESS, HEX = 12, r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
TOKEN, LEAST = r"[A-Za-z0-9+/_=.-]", 16
SAMPLE_DOCS, SAMPLE_RANDOM, LIMIT = 4_000, 1_000, 12.0
#: Steps of the sums that make positions, so that a text with very many matches takes time in proportion.
STEP = 256


def _segments(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).*?({pattern})|.+"), F.lit(group))


def _running(values: Column, start: Column | None = None) -> Column:
    """Sums up to and with each element."""
    first = F.lit(0).cast("long") if start is None else start
    none = F.array().cast("array<bigint>")
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all"))
    return F.aggregate(values, F.struct(first.alias("sum"), none.alias("all")), step, lambda acc: acc["all"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _ends(lengths: Column) -> Column:
    """Running sums in two levels of STEP."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(STEP))
    blocks = F.transform(starts, lambda s: F.slice(lengths, s, STEP))
    upto = _running(F.transform(blocks, _sum))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), upto.alias("u")), lambda x: _running(x["b"], x["u"] - _sum(x["b"]))))


SPANS = "array<struct<start:bigint,end:bigint,rank:int,text:string>>"


def spans(rows: DataFrame, name: str, pattern: str, kind: str, when: Column, value: int | None = None, least: int = 1) -> DataFrame:
    """Adds the spans of a pattern in text as column `name`: array of (start, end, rank of the kind, text).

    value: a group of the pattern that is to have `least` code points; matches that fail are dropped after the search.
    """
    empty = F.array().cast(SPANS)
    cut = rows.withColumn("_parts", F.when(when, _segments(F.col("text"), pattern, 0)))
    cut = cut.withColumn("_found", F.when(F.col("_parts").isNotNull(), _segments(F.col("text"), pattern, 1)))
    tested = _segments(F.col("text"), pattern, value + 1) if value else F.col("_found")
    cut = cut.withColumn("_values", F.when(F.col("_parts").isNotNull(), tested))
    cut = cut.withColumn("_lengths", F.transform("_parts", lambda p: F.length(p).cast("long")))
    cut = cut.withColumn("_ends", F.when(F.size("_parts") > 0, _ends(F.col("_lengths"))))
    zipped = F.arrays_zip(F.col("_ends").alias("e"), F.col("_found").alias("m"), F.col("_values").alias("v"))
    held = F.filter(zipped, lambda z: (F.length(z["m"]) > 0) & (F.length(z["v"]) >= least))
    made = F.transform(held, lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), z["m"].alias("text")))
    return cut.withColumn(name, F.coalesce(made.cast(SPANS), empty)).drop("_parts", "_found", "_values", "_lengths", "_ends")


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds assign, access, hex and long (whether a run of LEAST characters of TOKEN stands in the text). Empty texts for null."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("long", F.col("text").rlike(f"{TOKEN}{{{LEAST}}}"))
    rows = spans(rows, "assign", ASSIGN, "assign", F.col("text").rlike(ASSIGN), value=1, least=ASSIGN_VALUE)
    rows = spans(rows, "access", ACCESS, "access", F.col("long"))
    return spans(rows, "hex", HEX, "hex", F.col("long"))


def _score(token: Column, weights: Column) -> Column:
    """Sum of the weights of a token's pairs of characters, those with its two ends included."""
    end, size = len(TOKEN_CHARS), len(TOKEN_CHARS) + 1
    codes = F.transform(F.split(token, ""), lambda c: (F.instr(F.lit(TOKEN_CHARS), c) - 1))
    step = lambda acc, c: F.struct((acc["sum"] + F.get(weights, acc["last"] * size + c)).alias("sum"), c.alias("last"))
    return F.aggregate(F.array_append(codes, F.lit(end)), F.struct(F.lit(0.0).alias("sum"), F.lit(end).alias("last")), step, lambda acc: acc["sum"])


def _pair_counts(tokens: DataFrame) -> DataFrame:
    """label, pair (first code * size + second, ends included), count of tokens (label, token)."""
    end, size = len(TOKEN_CHARS), len(TOKEN_CHARS) + 1
    codes = F.transform(F.split("token", ""), lambda c: (F.instr(F.lit(TOKEN_CHARS), c) - 1))
    coded = tokens.select("label", F.concat(F.array(F.lit(end)), codes, F.array(F.lit(end))).alias("codes"))
    pairs = F.transform(F.slice("codes", F.lit(2), F.size("codes") - 1), lambda c, i: F.get(F.col("codes"), i) * size + c)
    return coded.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """token: n strings made from digests for each of a few alphabets of keys."""
    digest = F.sha2(F.concat(F.lit("random|"), F.col("id").cast("string")), 256)
    wide = F.base64(F.unhex(digest))
    kinds = [digest, wide, F.translate(wide, "+/=", "-_"), F.regexp_replace(wide, "[^A-Za-z0-9]", ""), F.upper(F.regexp_replace(wide, "[^A-Za-z0-9]", ""))]
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("token"))


def labelled(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_random: int = SAMPLE_RANDOM) -> DataFrame:
    """label (1: random, 0: ordinary), token from at most sample_docs different documents and the made strings."""
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("key"))
    last = hashed.select("key").distinct().orderBy("key").limit(sample_docs).agg(F.max("key")).first()[0]
    sample = hashed.where(F.col("key") <= F.lit(last)).dropDuplicates(["key"]) if last is not None else hashed.limit(0)
    found = base_spans(sample.select("text"))
    values = found.withColumn("values", F.transform(F.concat("assign", "access", "hex"), lambda s: F.regexp_extract(s["text"], rf"{TOKEN}+$", 0)))
    runs = F.regexp_extract_all("text", F.lit(f"{TOKEN}+"), F.lit(0))
    plain = F.filter(runs, lambda r: ~F.exists("values", lambda v: F.contains(r, v)))
    plain = values.select(F.explode(plain).alias("token"))
    return (
        plain.select(F.lit(0).alias("label"), F.explode(F.array("token", F.upper("token"))).alias("token"))
        .union(values.select(F.lit(1), F.explode("values")))
        .union(random_strings(spark, sample_random).select(F.lit(1), "token"))
        .where(F.length("token") > 1)
    )


def trained(tokens: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log of P(second | first, random) / P(second | first, ordinary) for every pair, from labelled tokens."""
    size = len(TOKEN_CHARS) + 1
    counts = {(row.label, row.pair): row["count"] for row in _pair_counts(tokens).collect()}  # at most 2 * size ** 2 rows
    chain = {}
    for label in (0, 1):
        for first in range(size):
            row = [counts.get((label, first * size + second), 0) + smooth for second in range(size)]
            chain[label, first] = [math.log(x / sum(row)) for x in row]
    return [r - o for first in range(size) for r, o in zip(chain[1, first], chain[0, first])]


def scanned(docs: DataFrame, weights: list[float], limit: float = LIMIT) -> DataFrame:
    """doc_id and the arrays assign, access, hex and random of spans (start, end, rank, text)."""
    rows = base_spans(docs.select("doc_id", "text"))
    rows = spans(rows, "tokens", f"{TOKEN}{{{LEAST},}}", "random", F.col("long"))
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.withColumn("tokens", F.when(F.size("tokens") > 0, apart).otherwise(F.col("tokens")))
    return rows.select("doc_id", "assign", "access", "hex", F.filter("tokens", lambda t: _score(t["text"], table) > limit).alias("random"))


def _joined(found: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(spark: SparkSession, docs: DataFrame, limit: float = LIMIT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_<kind> of each kind, base_sha256, spans for every document (doc_id, text)."""
    weights = trained(stored(spark, labelled(spark, docs, sample_docs), "secret-samples"))
    found = scanned(docs, weights, limit).withColumn("spans", _joined(F.concat(*KINDS))).withColumn("base_sha256", F.sha2(_joined(F.concat("assign", "access", "hex")), 256))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base_sha256", "spans", F.size("random").cast("long").alias("n_random"))
