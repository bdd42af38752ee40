"""Question filtering and evaluation: contract, pools, receipts, paired significance."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C

#: Fixed values of the record contract.
HELD_OUT = ("F2", "D7")
SOURCES = ("ast", "exec", "phrased", "stack")
KINDS = ("substring", "number", "yesno", "name", "letter", "line_ref", "list")


def violations() -> Column:
    """Every rule a record (row_idx, intent, held_out, question, answer, answer_type, source, options) breaks."""
    c = F.col
    rules = {
        "blank answer": F.trim(c("answer")) == "",
        "blank question": F.trim(c("question")) == "",
        "missing field": c("row_idx").isNull() | c("intent").isNull() | c("answer").isNull() | c("question").isNull(),
        "held-out flag": c("held_out") != c("intent").isin(*HELD_OUT),
        "letter answer": (c("answer_type") == "letter") & ~F.trim(c("answer")).rlike("^[A-D]$"),
        "letter without options": (c("answer_type") == "letter") & c("options").isNull(),
        "letter beyond options": (c("answer_type") == "letter") & c("options").isNotNull() & F.trim(c("answer")).rlike("^[A-D]$") & (F.ascii(F.trim(c("answer"))) - 64 > F.size("options")),
        "options without letter": (c("answer_type") != "letter") & c("options").isNotNull(),
        "unknown kind": ~c("answer_type").isin(*KINDS),
        "unknown source": ~c("source").isin(*SOURCES),
        "negative row": c("row_idx") < 0,
        "yesno answer": (c("answer_type") == "yesno") & ~F.lower(F.trim(c("answer"))).isin("yes", "no"),
        "number answer": (c("answer_type") == "number") & ~F.trim(c("answer")).rlike(r"^-?[0-9]+(\.[0-9]+)?$"),
        "collapsed names": (c("intent") == "I6") & (F.size(F.array_distinct(F.split(F.lower("answer"), r",\s*"))) < F.size(F.split("answer", r",\s*"))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())


def drop_reason(extra: Column | None = None) -> Column:
    """Why the filters drop a record, by the first stage that does: format:<reason> of the repaired question, leak, contract:<rule>; null if it stays.

    extra: more terms (array of strings) that the question must not show.
    """
    question, none = C.question_repair("question"), F.array().cast("array<string>")
    terms = C.leak_terms(F.col("answer"), F.col("answer_type"), none if extra is None else extra)
    return (
        F.when(C.format_reject(question).isNotNull(), F.concat(F.lit("format:"), C.format_reject(question)))
        .when(C.leaks(question, terms), "leak").when(F.size(violations()) > 0, F.concat(F.lit("contract:"), F.get(violations(), F.lit(0))))
    )


def narrowed(kind: Column) -> Column:
    """Upstream answer kinds to those of the contract."""
    return F.when(kind.isin("line_ref_text", "quote"), "substring").otherwise(kind)


def pool(conceptual: float) -> Column:
    """Trainer pool of a pair (held_out, intent, stacked, answer_type)."""
    c = F.col
    return (
        F.when(c("held_out"), "heldout").when(c("intent").startswith("I"), "retr").when(c("stacked"), "stack").when(c("intent").startswith("B") & (c("answer_type") == "substring"), "span")
        .when(c("intent").isin("C1", "C3"), "conceptual" if conceptual > 0 else "solo").otherwise("solo")
    )


def message(code: Column, names: Column | None, fact: Column, options: Column | None, answer: Column, style: Column) -> Column:
    """The phrasing prompt: fenced code, set names, fact, options, answer, style, in that order; absent parts leave no line."""
    part = lambda label, x: F.lit(None).cast("string") if x is None else F.concat(F.lit(label), x)
    fence = F.concat(F.lit("```\n"), code, F.lit("\n```"))
    return F.concat_ws("\n", fence, part("Functions: ", names), part("Fact: ", fact), part("Options: ", options), part("Answer: ", answer), part("Style: ", style))


def filled(template: str, fields: dict[str, Column]) -> Column:
    out: Column = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def slice_labels(predicates: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in predicates.items()]), lambda x: x.isNotNull())


def receipt_dedupe(rows: DataFrame, identity: str, reference: str, order: str) -> DataFrame:
    """The first of each (identity, reference) in order; rows without a reference all stay."""
    w = Window.partitionBy(identity, reference).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col(reference).isNull() | (F.col("_n") == 1)).drop("_n")


def attach(rows: DataFrame, references: DataFrame, identity: str, position: str | None = None) -> DataFrame:
    """References by position where the lengths agree and identities match, else by unique identity."""
    if position is not None and rows.count() == references.count():
        both = rows.alias("a").join(references.alias("b"), position)
        if not both.where(F.col(f"a.{identity}") != F.col(f"b.{identity}")).isEmpty():
            raise ValueError("positions and identities disagree")
        return both
    known = references.groupBy(identity).agg(F.count_distinct("reference").alias("n"), F.min("reference").alias("reference"))
    out = rows.join(known, identity, "left")
    if not out.where("n IS NULL OR n > 1").isEmpty():
        raise ValueError("a reference is missing or ambiguous")
    return out.drop("n")


def exact_p(left: int, right: int) -> float:
    """Two-sided exact binomial test of the discordant pairs, in whole numbers; 1 if there are none."""
    n, m = left + right, min(left, right)
    if n == 0:
        return 1.0
    return float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(m + 1)), 2**n)))


def mcnemar(flags: DataFrame) -> DataFrame:
    """Contingency of two flags a and b over all rows, and the exact p-value of their difference (one row)."""
    a, b = F.col("a"), F.col("b")
    counts = flags.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))
    return counts.withColumn("p", F.udf(exact_p, "double", useArrow=True)("left_only", "right_only"))


def heldout_arms(rows: DataFrame, trained_sample: int, seed: str = "0") -> DataFrame:
    """Rows of an evaluation with their arm: held-out pairs that pass the round trip, held-out ones that don't (advisory), and a sample of trained pairs.

    rows: a record's columns, context (solo or stack) and rt (round trip: true, false, or null for not run, which isn't
    a pass). Records that break the contract are in no arm. The sample is of trained pairs with a passed round trip and
    a context of their own, the least by a hash of seed and row_idx. Raises ValueError where a held-out flag doesn't fit its intent, where a
    held-out record stands in a stack, and where no held-out record passes.
    """
    if not rows.where(F.col("held_out").isNull() | (F.col("held_out") != F.col("intent").isin(*HELD_OUT))).isEmpty():
        raise ValueError("a held-out flag does not fit its intent")
    valid = rows.where(F.size(violations()) == 0)
    held, solo, passed = F.col("held_out"), F.col("context").eqNullSafe("solo"), F.coalesce("rt", F.lit(False))
    if not valid.where(held & ~solo).isEmpty():
        raise ValueError("a held-out record has a stack for context")
    if valid.where(held & passed).isEmpty():
        raise ValueError("no held-out record passes the round trip")
    tested = valid.where(held).withColumn("arm", F.when(passed, "heldout").otherwise("advisory"))
    order = F.md5(F.concat_ws("|", F.lit("trained"), F.lit(seed), F.col("row_idx")))
    trained = valid.where(~held & solo & passed).orderBy(order, "row_idx").limit(trained_sample)
    return tested.unionByName(trained.withColumn("arm", F.lit("trained")))
