"""Source-code operators: CPython's parser and tokenizer over Arrow batches, one parse of a row per operator."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import facts as facts_
from corpusmill.functions import pysource, sandbox, sequences


#: Rows of a batch that are Python objects at a time.
SLICE = 512


def _generated(rows: DataFrame, columns: list[str], keep: list[str], make: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """keep's columns and what make yields for the values of columns, in batches."""
    kept = T.StructType([rows.schema[c] for c in keep])
    made = T._parse_datatype_string(schema)
    full = T.StructType([*kept.fields, *made.fields])
    arrow = pa.schema(full_arrow(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch may hold long rows: a slice of it at a time is in Python's lists
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            heads = [batch.column(i).to_pylist() for i in range(len(keep))]
            inputs = [batch.column(len(keep) + i).to_pylist() for i in range(len(columns))]
            out = [(*(h[i] for h in heads), *row) for i, values in enumerate(zip(*inputs)) for row in make(*values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    # the same column may be kept and read
    given = rows.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"_in{i}") for i, c in enumerate(columns)])
    return given.mapInArrow(run, full)


def full_arrow(schema: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema]


def _scalar(make: Callable, kind: str) -> Callable[..., Column]:
    """A Python function as a column, in Arrow batches."""

    def call(*columns: Column | str) -> Column:
        return F.udf(make, kind, useArrow=True)(*columns)

    return call


FUNCTION = "name string, is_method boolean, start long, end long, code string, is_async boolean, decorated boolean, has_docstring boolean, typed boolean, string_share double, n_strings int"


def extract_functions(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    names = [f.split()[0] for f in FUNCTION.split(", ")]
    return _generated(files, [content], keep, lambda x: [tuple(r[n] for n in names) for r in pysource.functions(x or "")], FUNCTION)


FACT = "intent string, grp string, seed string, answer string, answer_type string, held_out boolean, needs_phrasing boolean, picked boolean"


def extract_facts(rows: DataFrame, keep: list[str], pool: list[str] | None = None, intents: tuple[str, ...] = ()) -> DataFrame:
    """One row per fact of each function: rows has code, qualified, func_name, is_method. seed is JSON with sorted keys.

    intents: only these (none: all registered).
    """

    def make(code: str, qualified: str, name: str, method: bool) -> list[tuple]:
        found = facts_.extract_facts(code or "", qualified or "", name or "", bool(method), pool, intents)
        return [(f.intent, facts_.INTENTS[f.intent].group, json.dumps(f.seed, sort_keys=True), f.answer, f.answer_type, f.held_out, f.needs_phrasing, f.picked) for f in found]

    return _generated(rows, ["code", "qualified", "func_name", "is_method"], keep, make, FACT)


def fact_events(rows: DataFrame, pool: list[str] | None = None, intents: tuple[str, ...] = (), screened: bool = True) -> DataFrame:
    """event (applicable, emitted, rejected, screened), intent, reason, n: sums of each batch of functions.

    screened: whether and why not a function's code may run too, by the reason's prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter[tuple] = Counter()
            for code, qualified, name, method in zip(*(c.to_pylist() for c in batch.columns)):
                for event, intent, reason, n in facts_.events(code or "", qualified or "", name or "", bool(method), pool, intents):
                    sums[event, intent, reason] += n
                if screened:
                    _, why = sandbox.screen(code or "")
                    sums["screened", None, why.split(":")[0] if why else "pass"] += 1
            if sums:
                columns = [*zip(*sums), tuple(sums.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()])], ["event", "intent", "reason", "n"])

    return rows.select("code", "qualified", "func_name", "is_method").mapInArrow(run, "event string, intent string, reason string, n long")


def coverage(rows: DataFrame, keep: list[str], pool: list[str] | None = None, intents: tuple[str, ...] = ()) -> DataFrame:
    """intent, emitted (facts), applicable (functions), leaks for every registered intent (or some), those with none included."""
    of = lambda test: F.sum(F.when(test, F.col("n")))
    sums = fact_events(rows, pool, intents, screened=False).where("intent IS NOT NULL").groupBy("intent").agg(
        of(F.col("event") == "emitted").alias("emitted"), of(F.col("event") == "applicable").alias("applicable"), of(F.col("reason") == "leak").alias("leaks")
    )
    known = rows.sparkSession.createDataFrame([(i,) for i in intents or facts_.INTENTS], "intent string")
    return known.join(sums, "intent", "left").select("intent", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("emitted", "applicable", "leaks")])


def reject_reasons(rows: DataFrame, keep: list[str], pool: list[str] | None = None, intents: tuple[str, ...] = ()) -> DataFrame:
    """event (rejected, screened), reason, n: a histogram."""
    return fact_events(rows, pool, intents).where("reason IS NOT NULL").groupBy("event", "reason").agg(F.sum("n").alias("n"))


def extract_stack_facts(stacks: DataFrame) -> DataFrame:
    """stacks: stack, decoy, members (array of id, qualified, func_name, code, is_method in order)."""

    def make(decoy: str | None, members: list[dict]) -> list[tuple]:
        return [(members[i]["id"], f.intent, json.dumps(f.seed, sort_keys=True), f.answer, f.answer_type) for i, f in facts_.stack_facts(members, decoy)]

    return _generated(stacks, ["decoy", "members"], ["stack"], make, "id long, intent string, seed string, answer string, answer_type string")


def calls(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns and calls, the names that each function calls (null where it doesn't parse); each is parsed once."""
    return _generated(rows, ["code"], keep, lambda x: [((pysource.function_facts(x or "") or {}).get("calls"),)], "calls array<string>")


def segments(rows: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return _generated(rows, [code], keep, lambda x: pysource.segments(x or ""), "kind string, start int, end int")


def char_classes(rows: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return _generated(rows, [code], keep, lambda x: pysource.char_classes(x or ""), "cls string, start int, end int")


def line_diff(rows: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    return _generated(rows, [a, b], keep, lambda x, y: pysource.line_diff(x or "", y or ""), "mark string, a_line string, b_line string")


def line_votes(rows: DataFrame, keep: list[str], samples: str) -> DataFrame:
    names = ("line", "winner", "votes", "samples", "unanimous", "top")
    return _generated(rows, [samples], keep, lambda x: [tuple(v[n] for n in names) for v in pysource.line_votes(x)] if x else [], "line int, winner string, votes int, samples int, unanimous boolean, top array<string>")


def run_functions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Sandboxed runs of each self-contained function, one child process per batch (see functions.sandbox)."""
    kept = T.StructType([rows.schema[c] for c in keep])
    full = T.StructType([*kept.fields, *T._parse_datatype_string("status string, reason string, intent string, seed string, answer string").fields])
    arrow = pa.schema(full_arrow(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [batch.column(i).to_pylist() for i in range(len(keep))]
            results = sandbox.facts_of(batch.column(len(keep)).to_pylist())
            out = [(*(h[i] for h in heads), *row) for i, rows_ in enumerate(results) for row in rows_]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.select(*keep, F.col("code").alias("_code")).mapInArrow(run, full)


is_stub = _scalar(pysource.is_stub, "boolean")
family = _scalar(pysource.family, "string")
verdict = _scalar(pysource.verdict, "string")
code_exact = _scalar(pysource.code_exact, "boolean")
code_normal = _scalar(pysource.code_normal, "string")
content_tokens = _scalar(pysource.content_tokens, "array<string>")
similarity = _scalar(sequences.ratio, "double")
rouge_l = _scalar(sequences.rouge_l, "double")
rouge_exceeds = _scalar(sequences.rouge_exceeds, "boolean")
aligned_f1 = _scalar(pysource.aligned_f1, "double")
function_facts = _scalar(pysource.function_facts, "struct<name:string,params:array<string>,calls:array<string>,strings:array<string>>")
parses = _scalar(pysource.parses, "boolean")
dedented = _scalar(pysource.dedented, "string")
source_style = _scalar(pysource.source_style, "struct<is_async:boolean,decorated:boolean,has_docstring:boolean,typed:boolean,is_method:boolean>")
