"""The verifier of multi-match questions: what each of them must hold, checked from the functions themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import columns as C

from . import source as S


def problems(questions: DataFrame, functions: DataFrame) -> DataFrame:
    """(question, problem) for every rule that a question breaks; none for a sound set. Raises ValueError where there is no question at all.

    questions: question (key), a, b (the pair), stack (ids, the pair among them), described, target, answer, told (strings a reader is shown).
    functions: id, code, name, repo, fam (the family it was filed under; the family is also worked out anew from the code).

    Only ids, names and families of the stacks are joined; code is read for pairs alone.
    """
    if questions.isEmpty():
        raise ValueError("no question to verify")
    name = C.short_name("name")
    slim = functions.select("id", F.lower(name).alias("low"), "fam")
    members = questions.select("question", F.explode("stack").alias("id"), F.array("a", "b").alias("pair")).join(slim, "id", "left")
    filler, matched = ~F.array_contains("pair", F.col("id")), F.array_contains("pair", F.col("id"))
    stacks = members.groupBy("question").agg(
        F.count_if(F.col("fam").isNull()).alias("unknown"), (F.count("low") - F.count_distinct("low")).alias("same_names"),
        (F.count(F.when(filler, F.col("fam"))) - F.count_distinct(F.when(filler, F.col("fam")))).alias("same_fams"),
        F.collect_set(F.when(filler, F.col("fam"))).alias("filler_fams"), F.collect_set(F.when(matched, F.col("id"))).alias("found"),
    )
    wanted = questions.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    read = functions.join(wanted, "id", "left_semi").select("id", name.alias("name"), "repo", "fam", S.family("code").alias("shape"), S.content_tokens("code", name).alias("toks"))
    side = lambda x: read.select(*[F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in read.columns])
    both = questions.join(side("a"), "a", "left").join(side("b"), "b", "left").join(stacks, "question", "left")
    c = F.col
    same = lambda column: c(f"{column}_a") == c(f"{column}_b")
    shown = F.exists("told", lambda x: F.contains(x, c("name_a")) | F.contains(x, c("name_b")))
    rules = {
        "unknown member": c("unknown").isNull() | (c("unknown") > 0) | c("shape_a").isNull() | c("shape_b").isNull() | (F.size("found") < 2),
        "shapes differ": ~same("shape"),
        "families differ": ~same("fam"),
        "too little alike": S.similarity(F.array_join("toks_a", " "), F.array_join("toks_b", " ")) < C.similarity_floor(F.least(F.size("toks_a"), F.size("toks_b"))),
        "names agree": F.lower("name_a") == F.lower("name_b"),
        "one repository": same("repo"),
        "answer": c("answer") != F.array_join(F.array_sort(F.array("name_a", "name_b")), ", "),
        "described": ~c("described").isin(c("a"), c("b")) | (c("target") != c("described")),
        "filler is a match": F.array_contains("filler_fams", c("fam_a")),
        "fillers agree": c("same_fams") > 0,
        "stack names agree": c("same_names") > 0,
        "name is told": shown,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return both.select("question", F.explode(broken).alias("problem"))
