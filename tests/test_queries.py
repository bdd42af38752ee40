"""Every query outside the optional subpackage against its DuckDB form on the smallest tables."""

import json

import duckdb
import pytest
from test_operators import plain_stacks

from corpusmill.functions import sequences
from corpusmill.operators import source as S
from corpusmill.plans import code, qa, registry
from tools.verify import TABLES, plain

#: slow to repeat for each intent; tools/verify.py runs them all
SAMPLED = [n for n in registry.ORACLES if not n.startswith("fact_") or n in ("fact_A11", "fact_B5", "fact_C7", "fact_F2")]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLED)
def test_same_as_sql(spark, sf, duck, name):
    frame = registry.QUERIES[name](spark, sf)
    names = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in frame.collect())
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


#: Queries without SQL and the test that holds each against plain Python.
ELSEWHERE = {"draw_exact": "test_draw", "phrase_clusters": "test_similar", "twins_greedy": "test_similar", "sequence_similarity": "test_sequences"}


def test_every_query_without_sql_is_compared():
    here = {"stacks_greedy", "side_by_side", "line_vote", "stack_facts", "multi_match"}
    assert {n for n in registry.QUERIES if n not in registry.ORACLES} == here | set(ELSEWHERE)


def test_stacks_are_one_plain_pass(spark, sf):
    docs = registry.table(spark, sf, "documents").collect()
    want = plain_stacks([(r.doc_id, "_".join(x for x in (r.source, r.lang) if x is not None)) for r in docs], 8)
    by = {}
    for r in registry.QUERIES["stacks_greedy"](spark, sf).collect():
        by.setdefault(r.stack, []).append((r.pos, r.id))
    assert sorted([i for _, i in sorted(s)] for s in by.values()) == sorted(want) and want


def test_both_sides_of_a_diff_are_the_texts(spark, sf):
    texts = {r.doc_id: (r.reference or "", r.gen or "") for r in qa.receipts(spark, sf).collect()}
    sides = {}
    for r in registry.QUERIES["side_by_side"](spark, sf).collect():
        sides.setdefault(r.doc_id, []).append(r)
    for doc, pair in texts.items():
        rows = sides.get(doc, [])
        assert all((r.mark == "=") == (r.a_line == r.b_line) for r in rows)
        for text, column in zip(pair, ("a_line", "b_line")):
            assert sorted(x for r in rows if (x := r[column]) is not None) == sorted(text.split("\n") if text else []) or sorted(x for r in rows if (x := r[column]) is not None) == sorted(text.splitlines())


def test_votes_are_counts_of_samples(spark, sf):
    turns = {}
    for r in registry.table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r.text)
    rows = registry.QUERIES["line_vote"](spark, sf).collect()
    assert {r.conv_id for r in rows} <= set(turns) and rows
    for r in rows:
        lines = [x.strip() for t in turns[r.conv_id] for x in t.split("\n")]
        assert 1 <= r.votes <= r.samples <= len(turns[r.conv_id]) and r.unanimous == (r.votes == r.samples)
        assert r.winner is None or r.winner.strip() in lines


def test_stack_facts_say_what_the_stacks_hold(spark, sf):
    stacks = {r.stack: ([m.func_name for m in r.members], r.decoy) for r in code.stacked(spark, sf).collect()}
    seen = set()
    for r in registry.QUERIES["stack_facts"](spark, sf).collect():
        names, decoy = stacks[r.stack]
        seed = json.loads(r.seed)
        seen.add((r.intent, r.answer if r.intent in ("I2", "I5") else ""))
        if r.intent == "I1":
            assert r.answer == names[seed["describe"]]
        elif r.intent == "I2":
            assert r.answer == "no" and seed["decoy"] == decoy and decoy not in names
        elif r.intent == "I3":
            assert seed["options"]["ABCD".index(r.answer)] == names[seed["describe"]] and len(set(seed["options"])) == 4
        elif r.intent == "I5":
            assert (seed["name"] in names) == (r.answer == "yes")
    assert {("I1", ""), ("I2", "no"), ("I3", ""), ("I4", ""), ("I5", "yes"), ("I5", "no")} == seen


def test_multi_match_pairs_are_twins_and_fillers_are_not(spark, sf):
    rows = code.rendered(spark, sf).select("p_partkey", "func_name", S.family("code").alias("fam"), S.content_tokens("code", "func_name").alias("toks")).collect()
    known, used = {r.p_partkey: r for r in rows}, set()
    found = registry.QUERIES["multi_match"](spark, sf).collect()
    for q in found:
        a, b = known[q.a], known[q.b]
        n = min(len(a.toks), len(b.toks))
        assert a.fam == b.fam == q.fam and sequences.ratio(" ".join(a.toks), " ".join(b.toks)) >= (0.90 if n < 8 else 0.75 if n < 20 else 0.65)
        assert q.a % 9 != q.b % 9 and q.answer == ", ".join(sorted((a.func_name, b.func_name))) and not {q.a, q.b} & used
        used |= {q.a, q.b}
        assert len({known[i].fam for i in q.fillers} | {q.fam}) == 7
    assert found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
