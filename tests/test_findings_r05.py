"""Round 5: pairs are pairs of documents, copies too."""

import itertools

import pytest

from corpusmill.operators import similar as S
from corpusmill.plans.registry import QUERIES


def put(spark, folder, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.selectExpr("*", "cast(length(text) AS long) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def crossing(rows):
    return sorted((min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(rows, 2) if a != b and s != t)


def test_family_pairs_are_pairs_of_documents(spark, tmp_path):
    copies = [(i, "lorem ipsum dolor", "en", f"s{i % 3}") for i in range(12)]
    others = [(20, "dolor ipsum lorem", "en", "s1"), (20, "a b c", "en", "s2"), (21, "lorem ipsum", "en", "s1"), (None, "a b c", "en", "s0"), (22, "a b c", "en", None), (23, None, "en", "s0")]
    got = QUERIES["family_pairs"](spark, put(spark, tmp_path, copies + others)).collect()
    assert sorted((r.a, r.b) for r in got) == crossing([(i, s) for i, _, _, s in copies] + [(20, "s1"), (20, "s2")])
    assert len({r.fam for r in got}) == 1


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_members_meet_once_however_they_are_cut(spark, block):
    rows = [("x", i, f"s{i % 4}") for i in range(17)] + [("y", i, f"s{i % 3}") for i in range(10, 22)] + [("x", 5, "s2"), ("x", None, "s1"), ("y", 3, None), (None, 4, "s0")]
    members = spark.createDataFrame(rows, "key string, id long, side string")
    got = S.linked(spark, spark.createDataFrame([("x", "x", 1.0), ("y", "x", 0.5)], "x string, y string, sim double"), members, block).collect()
    x, y = ([(i, s) for k, i, s in rows if k == key and i is not None and s] for key in "xy")
    assert sorted((r.a, r.b) for r in got if r.sim == 1) == crossing(x)
    assert sorted((r.a, r.b) for r in got if r.sim == 0.5) == sorted((min(i, j), max(i, j)) for (i, s), (j, t) in itertools.product(x, y) if i != j and s != t)


def test_jaccard_pairs_are_pairs_of_documents(spark, tmp_path):
    copies = [(i, "one two three four five six seven eight nine ten", "en", f"s{i % 3}") for i in range(9)]
    others = [(30, "one two three four five six seven eight nine x", "en", "s1"), (20, "ten nine eight seven six five four three two one", "en", "s1"), (21, "?!", "en", "s1"), (22, "?!", "en", "s2"), (23, None, "en", "s0")]
    got = {(r.a, r.b): r.sim for r in QUERIES["jaccard_pairs"](spark, put(spark, tmp_path, copies + others)).collect()}
    same = crossing([(i, s) for i, _, _, s in copies] + [(20, "s1")])
    assert {p for p, sim in got.items() if sim == 1} == set(same)
    assert {p for p, sim in got.items() if sim == 9 / 11} == {(i, 30) for i, _, _, s in copies if s != "s1"} and len(got) == len(same) + 6


def test_an_id_that_comes_twice_has_both_its_sets(spark, tmp_path):
    rows = [(5, "a b c d e f g h", "en", "s1"), (5, "a b c d e f g i", "en", "s2"), (6, "a b c d e f g h", "en", "s3")]
    got = QUERIES["jaccard_pairs"](spark, put(spark, tmp_path, rows)).collect()
    assert sorted((r.a, r.b, r.sim) for r in got) == [(5, 6, 7 / 9)] * 2 + [(5, 6, 1.0)] * 2
