"""Similarity joins and phrase clusters against plain folds and brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import corpus as O
from corpusmill.operators import similar as S
from corpusmill.plans import corpus as P
from corpusmill.plans.registry import QUERIES, table


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def fold(rows, cap, floor=0.85):
    """One pass over (pair_id, question) of an intent in md5 order, all earlier questions tried: pair_id -> (cluster, kept)."""
    order = sorted(rows, key=lambda r: (hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    exact, known, size, out = {}, [], {}, {}
    for pair, question in order:
        question = question or ""
        if question not in exact:
            own = re.findall("[a-z0-9_]+", question.lower())
            tried = sorted((-len(set(own) & set(t)), i) for i, (t, _) in enumerate(known) if set(own) & set(t))
            near = [c for n, i in tried for t, c in [known[i]] if -2 * n >= len(set(own)) and 2 * lcs(own, t) / (len(own) + len(t)) > floor]
            exact[question] = near[0] if near else pair
            known.append((own, exact[question]))
        c = exact[question]
        size[c] = size.get(c, 0) + 1
        out[pair] = (c, size[c] <= cap)
    return out


def made_up(n, seed):
    rng = random.Random(seed)
    words = "what does the function return when a list is empty or none and why would it raise here".split()
    out = []
    for i in range(n):
        base = words[: rng.randrange(3, len(words))]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = rng.choice(["x", "y", "the", f"n{rng.randrange(9)}"])
        out.append((f"p{i}", " ".join(base)))
    return out + [("none", None), ("blank", ""), ("marks", "?!"), ("marks2", "?!"), ("twice", "the the the the the the"), ("thrice", "the the the the the the the")]


@pytest.mark.parametrize("block", [S.BLOCK, 4])
def test_phrase_clusters_are_the_fold(spark, block):
    rows = [(intent, f"{intent}{p}", q) for intent in "AB" for p, q in made_up(220 if intent == "A" else 60, ord(intent))]
    frame = spark.createDataFrame(rows, "intent string, pair_id string, question string")
    out = S.phrase_clusters(spark, frame, cap=3, block=block).collect()
    got = {r.pair_id: (r.cluster, r.kept) for r in out}
    assert len(out) == len(rows)
    for intent in "AB":
        want = fold([(p, q) for i, p, q in rows if i == intent], 3)
        assert {p: got[p] for p in want} == want
    assert len({c for c, _ in got.values()}) < len(rows) / 2


def test_phrase_clusters_of_whole_turns(spark, sf):
    rows = table(spark, sf, "conversations").select("role", F.concat_ws("-", "conv_id", "turn").alias("p"), C.text_norm("text").alias("q")).collect()
    got = {r.pair_id: (r.cluster, r.kept) for r in QUERIES["phrase_clusters"](spark, sf).collect()}
    want = {}
    for role in {r.role for r in rows}:
        want |= fold([(r.p, r.q) for r in rows if r.role == role], 5)
    assert got == want


def test_no_questions(spark):
    assert S.phrase_clusters(spark, spark.createDataFrame([], "intent string, pair_id string, question string")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similar_sets_lose_no_pair(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        base = set(rng.sample(range(40), rng.randrange(1, 30))) if i % 3 else set(range(20)) ^ set(rng.sample(range(24), 3))
        rows.append((f"g{i % 2}", i, f"s{i % 5}", [str(x) for x in base], (0.9, 0.75, 0.65)[i % 3]))
    rows += [("g0", 900, "s1", [], 0.65), ("g0", 901, "s2", [], 0.65), (None, 902, "s1", ["1"], 0.65), ("g0", 903, None, ["1"], 0.65), ("g0", 904, "s1", None, 0.65)]
    got = {(r.a, r.b): r.sim for r in S.similar_sets(spark, spark.createDataFrame(rows, "grp string, id long, side string, elements array<string>, floor double")).collect()}
    sets = [(g, i, s, set(e or []), f) for g, i, s, e, f in rows if g and s]
    want = {(a[1], b[1]): jaccard(a[3], b[3]) for a in sets for b in sets if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and jaccard(a[3], b[3]) >= max(a[4], b[4])}
    assert want and got == want


def test_a_family_of_equal_texts_gives_few_pairs(spark, tmp_path):
    rows = [(i, "one two three four five six seven eight nine ten", "en", f"s{i % 3}") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    pairs = QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.sim, r.n_a, r.n_b) for r in sorted(pairs)] == [(0, 1, 1.0, 300, 300), (0, 2, 1.0, 300, 300), (1, 2, 1.0, 300, 300)]
    assert {(r.doc_id, r["class"]) for r in QUERIES["jaccard_classes"](spark, str(tmp_path)).collect()} == {(i, i % 3) for i in range(900)}


def test_twins_are_the_best_first_choice(spark, sf):
    pairs = P.similar_classes(spark, sf).collect()
    want = []
    for fam in {r.fam for r in pairs}:
        used, n = set(), 0
        for r in sorted((r for r in pairs if r.fam == fam), key=lambda r: (-r.sim, hashlib.md5(f"{r.a}|{r.b}".encode()).hexdigest())):
            if n < 16 and not {r.a, r.b} & used:
                used |= {r.a, r.b}
                n += 1
                want.append((fam, r.a, r.b))
    assert sorted((r.fam, r.a, r.b) for r in QUERIES["twins_greedy"](spark, sf).collect()) == sorted(want)


def test_roots(spark):
    up = spark.createDataFrame([(i, i - 1) for i in range(1, 70)], "node long, root long")
    assert {(r.node, r.root) for r in S.roots(spark, up).collect()} == {(i, 0) for i in range(1, 70)}
    assert O.disjoint_pairs(spark.createDataFrame([], "fam string, a long, b long, sim double")).count() == 0
