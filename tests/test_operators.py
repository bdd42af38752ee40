"""Invariants and cases of operators that SQL can't express, on small inputs of our own."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import corpus as O
from corpusmill.operators import evaluation as E
from corpusmill.operators import similar


def test_status_is_total_and_exclusive(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0) for i in range(210)], "id long, excl_hash boolean, excl_repo boolean, dup boolean, junk boolean")
    out = O.status(rows).collect()
    assert len(out) == 210
    for r in out:
        flags = [f for f in O.PRECEDENCE if r[f]]
        assert r.status == (flags[0] if flags else "eligible")


def test_exclusion_fails_closed(spark):
    rows = spark.createDataFrame([("h1", "R")], "h string, repo string")
    with pytest.raises(ValueError):
        O.excluded(rows, rows.select("h").where("false"), rows.select("repo"))


def test_first_seen_counts_excluded_copies(spark):
    rows = spark.createDataFrame([(0, 5, "a"), (0, 7, "a"), (1, 1, "a"), (1, 2, "b")], "pile int, id int, h string")
    assert {r.id: r.dup for r in O.first_seen(rows, "h", ["pile", "id"]).collect()} == {5: False, 7: True, 1: True, 2: False}


@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 200))
@settings(max_examples=80, deadline=None)
def test_water_fill(supply, total):
    out = O.water_fill(supply, total)
    assert sum(out.values()) == min(total, sum(supply.values())) and all(0 <= out[k] <= supply[k] for k in supply)
    open_ = [out[k] for k in supply if out[k] < supply[k]]
    assert not open_ or max(open_) - min(open_) <= 1 or total >= sum(supply.values())


def test_quota_targets_and_band_allocation():
    out = O.quota_targets({("A", "A1"): 100, ("A", "A2"): 5, ("B", "B1"): 10, ("C", "C1"): 0}, {"A": 0.5, "B": 0.3, "C": 0.2}, 60)
    assert sum(out.values()) == 60 and out["A", "A2"] == 5 and out["B", "B1"] == 10 and out["C", "C1"] == 0
    assert O.band_allocation({0: 3, 1: 100, 2: 100}, {0: 0.5, 1: 0.25, 2: 0.25}, 40) == {0: 3, 1: 19, 2: 18} or sum(O.band_allocation({0: 3, 1: 100, 2: 100}, {0: 0.5, 1: 0.25, 2: 0.25}, 40).values()) == 40


def test_disjoint_pairs_and_stacks(spark):
    pairs = spark.createDataFrame([("f", 1, 2, 0.9), ("f", 2, 3, 0.95), ("f", 1, 4, 0.8), ("g", 5, 6, 0.7)], "fam string, a long, b long, sim double")
    assert sorted((r.a, r.b) for r in O.disjoint_pairs(pairs).collect()) == [(1, 4), (2, 3), (5, 6)]
    rows = spark.createDataFrame([(i, f"n{i % 11}") for i in range(100)], "id long, name string")
    out = O.stacks(spark, rows, 8).collect()
    by = {}
    for r in out:
        by.setdefault(r.stack, []).append(r.id)
    assert all(len(x) == 8 and len({i % 11 for i in x}) == 8 for x in by.values()) and len({r.id for r in out}) == len(out)


def plain_stacks(rows, size):
    """One pass in md5 order and one over what it left."""
    made, now, late = [], [], []
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    for again in (order, late):
        for r in list(again):
            if r[1] in {x[1] for x in now}:
                if again is order:
                    late.append(r)
                continue
            now.append(r)
            if len(now) == size:
                made.append([x[0] for x in now])
                now = []
    return made


def test_stacks_are_the_plain_pass_and_do_not_know_partitions(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if rng.random() < 0.3 else f"n{rng.randrange(40)}") for i in range(3_000)]
    frame = spark.createDataFrame(rows, "id long, name string")
    packed = lambda f, **more: {tuple(x.id for x in sorted(v, key=lambda x: x.pos)) for v in group(O.stacks(spark, f, 8, **more).collect()).values()}

    def group(found):
        by = {}
        for r in found:
            by.setdefault(r.stack, []).append(r)
        return by

    assert packed(frame) == {tuple(x) for x in plain_stacks(rows, 8)}
    one, many = (packed(frame.repartition(n), width=100, fan=4) for n in (1, 64))
    assert one == many and len(one) >= 0.9 * len(plain_stacks(rows, 8))
    names = dict(rows)
    assert all(len(s) == 8 == len({names[i] for i in s}) for s in one) and len({i for s in one for i in s}) == 8 * len(one)
    assert O.stacks(spark, frame.limit(0)).count() == 0


def test_spans_stand_at_their_places(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abé ") for _ in range(300))
    files = [(f"k{i % 2}", base[: 100 + i] + rng.choice("xy") * 3 + base[i:]) for i in range(12)] + [("k0", base), ("k0", base), ("k1", ""), ("k2", None)]
    spans = []
    for i in range(120):
        key, text = rng.choice(files[:14])
        raw = text.encode()
        start = rng.randrange(len(raw))
        end = min(len(raw), start + rng.choice((0, 1, 20, 40, 200)))
        code = raw[start:end] if i % 3 else raw[start:end][::-1]
        spans.append((i, key if i % 7 else "k9", start, end, bytearray(code)))
    out = O.slice_at(spark, spark.createDataFrame(files, "k string, content string"), spark.createDataFrame(spans, "span_id long, k string, start int, end int, code binary"), ["k"])
    own = {k: [c.encode() for x, c in files if x == k and c is not None] for k, *_ in files}
    want = {i: (any(c[a:b] == bytes(code) for c in own.get(k, [])), len(own.get(k, []))) for i, k, a, b, code in spans}
    assert {r.span_id: (r.ok, r.parents) for r in out.collect()} == want and {ok for ok, _ in want.values()} == {True, False}


def test_the_next_row_of_the_last_is_the_first(spark):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "id long, v string").repartition(7)
    assert {r.id: r.w for r in O.cyclic_next(spark, frame, "v", "id", "w").collect()} == {i: f"v{(i + 1) % 100}" for i in range(100)}
    assert O.cyclic_next(spark, frame.limit(1), "v", "id", "w").first().w == O.cyclic_next(spark, frame.limit(1), "v", "id", "w").first().v
    assert O.cyclic_next(spark, frame.limit(0), "v", "id", "w").count() == 0


def test_phrase_clusters_remember_rejected(spark):
    rows = [("A", f"p{i}", "what does the function return when the list is empty") for i in range(6)] + [("A", "q", "what does the function return when the list is blank"), ("A", "z", "an entirely different question")]
    out = {r.pair_id: (r.cluster, r.kept) for r in similar.phrase_clusters(spark, spark.createDataFrame(rows, "intent string, pair_id string, question string"), cap=3).collect()}
    assert sum(k for p, (_, k) in out.items() if p != "z") == 3 and out["z"][1] and len({c for c, _ in out.values()}) == 2


def test_torn_shards_fail(spark):
    a, b = spark.range(5).toDF("line"), spark.range(4).toDF("line")
    with pytest.raises(ValueError):
        O.aligned(a.withColumn("x", F.lit(1)), b.withColumn("y", F.lit(1)), ["line"])
    with pytest.raises(ValueError):
        E.attach(a.toDF("id").withColumn("gen", F.lit("g")), spark.createDataFrame([(0, "r")], "id long, reference string"), "id")


def test_band_edges(spark):
    rows = spark.createDataFrame([(n,) for n in (15, 16, 63, 64, 2047, 2048, 4095, 4096, 4097)], "n long").select("n", C.band("n").alias("b")).collect()
    assert [r.b for r in rows] == [None, 0, 0, 1, 3, 4, 4, 4, None]


@pytest.mark.parametrize(
    ("question", "term", "leak"),
    [("is it 3 or not", "3", True), ("is it 3.5", "3", False), ("x13 y", "13", False), ("call add_numbers", "add", False), ("call add now", "add", True), ("the [] here", "[]", True), ("obj.attr", ".", False), ("a # b", "#", True), ("foo-bar baz", "foo-bar", True), ("a \\E trick", "\\E", False), ("a \\e.x trick", "\\e.x", True)],
)
def test_leaks(spark, question, term, leak):
    row = spark.createDataFrame([(question, term)], "q string, t string").select(C.leaks(F.col("q"), C.leak_terms(F.col("t"), F.lit("substring"), F.array().cast("array<string>"))).alias("x")).first()
    assert row.x == leak


def test_question_repair(spark):
    cases = {"<think>a\nb</think>  `What is it?`": "What is it?", 'Question: "Why  so?"': "Why so?", "Question: Q: both": "both", "plain": "plain", "'q'": "q"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.question_repair("t").alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases


def test_permuted_partitions_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", C.content_hash("text").alias("h"))
    a = sorted(r.doc_id for r in O.dedup(docs, "h", ["source", "doc_id"]).collect())
    b = sorted(r.doc_id for r in O.dedup(docs.repartition(13).orderBy(F.rand(3)), "h", ["source", "doc_id"]).collect())
    assert a == b


@given(st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_exact_p(left, right):
    p = E.exact_p(left, right)
    assert 0 < p <= 1 and p == E.exact_p(right, left) and (left != right or p == 1)


def test_contract(spark):
    rows = [
        (1, "A1", False, "q?", "x", "substring", "ast", None), (2, "C7", False, "q?", "D", "letter", "ast", ["a", "b", "c"]), (3, "F2", False, "q?", "a", "list", "ast", None), (4, "A1", False, "q?", " ", "substring", "ast", None),
        (5, "I6", False, "q?", "Add, add", "name", "stack", None), (6, "A9", False, "q?", "maybe", "yesno", "web", None),
    ]
    frame = spark.createDataFrame(rows, "row_idx long, intent string, held_out boolean, question string, answer string, answer_type string, source string, options array<string>")
    out = {r.row_idx: set(r.v) for r in frame.select("row_idx", E.violations().alias("v")).collect()}
    assert out == {1: set(), 2: {"letter beyond options"}, 3: {"held-out flag"}, 4: {"blank answer"}, 5: {"collapsed names"}, 6: {"yesno answer", "unknown source"}}


def test_global_rank_is_the_order(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(9)
    got = {r.id: r.rank for r in O.global_rank(spark, rows, ["g", F.desc("k")]).collect()}
    want = sorted(range(1000), key=lambda i: (i % 3, -(i * 7919 % 1000)))
    assert got == {i: n for n, i in enumerate(want, 1)}
    assert O.global_rank(spark, rows.where("false"), ["k"]).count() == 0


def _heldout_row(intent, rt, held_out=None, context="solo", answer="x1", at=0):
    return (at, intent, intent in E.HELD_OUT if held_out is None else held_out, "What is returned here?", answer, "substring", "ast", None, context, rt)


HELDOUT = "row_idx long, intent string, held_out boolean, question string, answer string, answer_type string, source string, options array<string>, context string, rt boolean"


def test_heldout_arms(spark):
    cases = [("F2", True), ("F2", False), ("D7", True), ("D7", None), ("G4", True), ("G4", False)]
    rows = [_heldout_row(i, rt, at=k) for k, (i, rt) in enumerate(cases)] + [_heldout_row("I1", True, context="stack", at=6), _heldout_row("G4", True, answer="  ", at=7)]
    arms = {r.row_idx: r.arm for r in E.heldout_arms(spark.createDataFrame(rows, HELDOUT), 10).collect()}
    assert arms == {0: "heldout", 1: "advisory", 2: "heldout", 3: "advisory", 4: "trained"}
    many = [_heldout_row("F2", True)] + [_heldout_row("G4", True, at=k) for k in range(1, 40)]
    drawn = [{r.row_idx for r in E.heldout_arms(spark.createDataFrame(x, HELDOUT), 7).where("arm = 'trained'").collect()} for x in (many, many[::-1])]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 7


@pytest.mark.parametrize("rows", [[_heldout_row("F2", True), _heldout_row("F2", True, held_out=False)], [_heldout_row("F2", True), _heldout_row("D7", True, context="stack")], [_heldout_row("F2", False)], []])
def test_heldout_arms_refuse(spark, rows):
    with pytest.raises(ValueError):
        E.heldout_arms(spark.createDataFrame(rows, HELDOUT), 10)


def test_verifier_refuses_an_empty_set(spark):
    from corpusmill.operators import twins

    asked = spark.createDataFrame([], "question long, a long, b long, stack array<long>, described long, target long, answer string, told array<string>")
    with pytest.raises(ValueError):
        twins.problems(asked, spark.createDataFrame([], "id long, code string, name string, repo string, fam string"))


def test_coverage_lists_every_intent(spark):
    from corpusmill.functions import facts
    from corpusmill.operators import source as S

    code = "def f(a, b=1):\n    if a:\n        return b\n    return a"
    rows = spark.createDataFrame([(k, code, "m.f", "f", False) for k in range(3)] + [(3, "def (", "m.g", "g", False)], "id long, code string, qualified string, func_name string, is_method boolean")
    found = {r.intent: r for r in S.coverage(rows, ["id"]).collect()}
    assert set(found) == set(facts.INTENTS) and found["A1"].applicable == 3
    for intent, r in found.items():
        facts_of = [len([f for f in facts.extract_facts(code, "m.f", "f", False) if f.intent == intent])]
        assert (r.emitted, r.applicable) == (3 * facts_of[0], 3 * (facts_of[0] > 0))
