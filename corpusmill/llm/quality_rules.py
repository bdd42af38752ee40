"""Quality rules as weak supervision (DataFrame and SQL functions only).

Each rule looks for one sign and votes when it sees it, bad (-1) or good (1), else it abstains (0).
Expectation-maximisation over the counts of vote patterns estimates, without labels, how many documents
are good and how often each rule fires on good and on bad ones, which gives its accuracy, the share of
its votes that are right. The posterior of "good" given votes and abstentions replaces all-must-pass filtering.

There are at most 2 ** len(RULES) patterns, whatever the corpus: those counts alone reach the driver,
where the EM runs; the posterior goes back as one SQL expression. Statistics are per document inside
one row (arrays in the JVM), so no group of rows is ever gathered and nothing is shuffled but counts.

Windows of words and words of a stretch are compared by 64-bit hashes (chained for windows), so of two different ones
in one text one pair in 10^19 counts as equal. Null and empty texts have no words and fail the base rules. Very long texts are
read whole, in time in proportion (times a logarithm where windows repeat). Repeated rows each get their own result. An empty
table gives an empty one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored

WINDOW, STRETCH = 8, 50
#: name: (vote, when); otherwise the rule abstains. Columns are those of statistics().
RULES: dict[str, tuple[int, str]] = {
    "symbols": (-1, "n_symbols > 0.1 * n_words"),
    "repeats": (-1, "n_repeat_words > 0.3 * n_words"),
    "lines": (-1, "n_lines >= 4 AND n_dup_lines > 0.3 * n_lines"),
    "capitals": (-1, "n_upper > 0.3 * word_chars"),
    "marks": (-1, "n_marks > 0.15 * n_words"),
    "word_length": (-1, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "variety": (-1, "n_words >= 15 AND n_local_words < 0.4 * n_words"),
    "stops": (-1, "n_words >= 40 AND n_stops < 0.01 * n_words"),
    "sentences": (1, "n_words >= 10 AND n_stops BETWEEN 0.03 * n_words AND 0.4 * n_words AND n_symbols <= 0.02 * n_words"),
    "calm": (1, "n_upper BETWEEN 0.005 * word_chars AND 0.12 * word_chars AND n_marks <= 0.02 * n_words AND n_symbols <= 0.02 * n_words"),
    "fresh": (1, "n_local_words >= 0.7 * n_words AND n_repeat_words <= 0.05 * n_words AND n_symbols <= 0.02 * n_words AND n_marks <= 0.02 * n_words"),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and whole-text counts. One column per step, so that no array is built twice."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", text.alias("text")).withColumn("words", words)
    step = step.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    step = step.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"!").alias("n_marks"),
        count(r"[.,;:?](?=[\x20\x09-\x0D]|$)").alias("n_stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = lambda i, j: F.get(F.col("hashes"), i + j)
    starts = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    # distinct words of each stretch of words, summed: a share of n_words that doesn't fall with a text's length
    stretches = F.sequence(F.lit(1), F.size("hashes"), F.lit(STRETCH))
    local = F.aggregate(stretches, F.lit(0).cast("long"), lambda a, i: a + F.size(F.array_distinct(F.slice("hashes", i, STRETCH))))
    step = step.withColumn("n_local_words", F.when(F.size("hashes") > 0, local).otherwise(F.lit(0).cast("long"))).withColumn("windows", windows).drop("hashes")
    step = step.withColumn("repeated", F.size("windows") > F.size(F.array_distinct("windows")))
    # hash and start, in order: equal windows are neighbours
    pairs = F.when(F.col("repeated"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("pairs", pairs).drop("windows")
    same = lambda p, j: F.coalesce(F.get(F.col("pairs"), j)["h"] == p["h"], F.lit(False))
    twice = F.filter("pairs", lambda p, j: same(p, j + 1) | F.when(j > 0, same(p, j - 1)).otherwise(F.lit(False)))
    step = step.withColumn("again", F.sort_array(F.transform(twice, lambda p: p["i"]))).drop("pairs")
    gaps = F.transform("again", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("again"), j + 1) - s, F.lit(WINDOW))).cast("long"))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return step.withColumn("n_repeat_words", covered).drop("again", "repeated")


def votes(stats: DataFrame) -> DataFrame:
    """Adds vote_<rule>: -1, 0 or 1."""
    vote = lambda way, when: F.expr(f"CASE WHEN n_words > 0 AND ({when}) THEN {way} ELSE 0 END")
    return stats.select("*", *[vote(*rule).alias(f"vote_{name}") for name, rule in RULES.items()])


def fit(patterns: list[tuple[tuple[int, ...], int]], ways: tuple[int, ...], rounds: int = 200, prior: float = 0.8, weight: float = 20.0) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, count): the share of good documents, and each rule's rate of firing on good and on bad ones.

    ways: how each rule votes. Rates start from what a usable rule does and keep a Beta prior of that
    mean worth `weight` documents, so that rules which never fire stay defined; a rule can become
    worthless but not change sides, so the classes can't swap.
    """
    start = [(0.7, 0.3) if way > 0 else (0.01, 0.3) for way in ways]
    rates = list(start)
    for _ in range(rounds if patterns else 0):
        good = bad = 0.0
        fired = [[weight * g, weight * b] for g, b in start]
        for pattern, count in patterns:
            p = posterior(pattern, prior, rates)
            good += p * count
            bad += (1 - p) * count
            for r, v in enumerate(pattern):
                if v:
                    fired[r][0] += p * count
                    fired[r][1] += (1 - p) * count
        moved = [_rates(g / (good + weight), b / (bad + weight), way) for (g, b), way in zip(fired, ways)]
        shift = max((abs(a - b) for x, y in zip(rates, moved) for a, b in zip(x, y)), default=0.0)
        rates, prior = moved, min(0.99, max(0.01, good / (good + bad)))
        if shift < 1e-9:
            break
    return prior, rates


def _rates(good: float, bad: float, way: int) -> tuple[float, float]:
    good, bad = (min(0.9999, max(0.0001, x)) for x in (good, bad))
    return (max(good, bad), bad) if way > 0 else (min(good, bad), bad)


def accuracies(prior: float, rates: list[tuple[float, float]], ways: tuple[int, ...]) -> list[float]:
    """Share of each rule's votes that are right."""
    return [(prior * g if way > 0 else (1 - prior) * b) / (prior * g + (1 - prior) * b) for (g, b), way in zip(rates, ways)]


def posterior(pattern: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    """Probability of good from which rules voted and which abstained."""
    odds = math.log(prior / (1 - prior)) + sum(math.log(g / b) if v else math.log((1 - g) / (1 - b)) for v, (g, b) in zip(pattern, rates))
    return 1 / (1 + math.exp(-odds))


def posterior_column(prior: float, rates: list[tuple[float, float]]) -> Column:
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (g, b) in zip(RULES, rates):
        odds = odds + F.when(F.col(f"vote_{name}") != 0, F.lit(math.log(g / b))).otherwise(F.lit(math.log((1 - g) / (1 - b))))
    return 1 / (1 + F.exp(-odds))


def judge(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, base_failed, quality (the posterior) and kept."""
    voted = stored(spark, votes(statistics(docs)), "quality-votes")
    names = [f"vote_{name}" for name in RULES]
    usable = voted.where("n_words > 0").groupBy(*names).count().collect()  # at most 2 ** len(RULES) rows
    patterns = sorted((tuple(row[n] for n in names), row["count"]) for row in usable)
    prior, rates = fit(patterns, tuple(way for way, _ in RULES.values()))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.withColumn("base_failed", failed).withColumn("quality", posterior_column(prior, rates))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names)
