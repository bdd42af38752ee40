from itertools import islice

import duckdb
import numpy as np
import pytest

from corpusmill.llm import hard_negatives as H
from corpusmill.llm.queries import ORACLES, QUERIES

SCHEMA = "id long, label long, vector array<long>"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1)


def slow(rows, anchors, k=5):
    """rows, anchors: (id, label, vector)"""
    clean = {(i, c, tuple(v)) for i, c, v in rows if None not in (i, c, v)}
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in anchors if None not in (i, c, v)}:
        others = sorted((-dot(v, w), j, d) for j, d, w in clean if j != i)
        for p, j, _ in [x for x in others if x[2] == c][:k]:
            fit = [x for x in others if x[2] != c and -80 * p <= -100 * x[0] <= -100 * p][:k]
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, anchors, **more):
    frame = H.mine(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(anchors, SCHEMA), **more)
    assert frame.columns == NAMES
    return sorted(tuple(r) for r in frame.collect())


def made_up(seed, n, dim=8, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (5, dim))
    rows = [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 5)] + rng.integers(-30, 30, dim)).tolist()) for i in range(n)]
    return rows + [(n + i, i % 3, centres[0].tolist()) for i in range(copies)]


def test_search_is_nearest_first_and_complete():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-9, 9, (700, 4))
    ids, labels = rng.permutation(700), rng.integers(0, 3, 700)
    reach = float((vectors**2).sum(1).max())
    tree = H.VPTree(ids, labels, vectors, reach, leaf=8)
    for i in range(40):
        least, most = sorted(rng.integers(-200, 200, 2).tolist())
        query = H.Query(int(ids[i]), int(labels[i]), vectors[i], reach)
        for same in (True, False):
            scores = vectors @ vectors[i]
            want = sorted((-int(s), int(j)) for s, j, c in zip(scores, ids, labels) if (c == labels[i]) == same and j != ids[i] and least <= s <= most)
            assert [(-s, j) for j, s in islice(tree.nearest(query, least, most, same, 9), 9)] == want[:9]


@pytest.mark.parametrize("more", [{}, {"sample_rows": 20, "shard_rows": 40, "anchor_block": 7}])
def test_against_brute_force(spark, more, monkeypatch):
    monkeypatch.setattr(H, "LEAST_ROWS", 10 if more else H.LEAST_ROWS)
    rows = made_up(1, 600, copies=200)  # a quarter are copies of one vector, which anchors share
    anchors = [r for r in rows if r[0] % 10 == 0]
    want = slow(rows, anchors)
    assert want and found(spark, rows, anchors, **more) == want


def test_query_against_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.sql(ORACLES["op13_hard_negatives"])
    assert want.columns == NAMES
    assert sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, sf).collect()) == sorted(want.fetchall())


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [3, 4]), (1, 1, [3, 4]), (2, 1, []), (3, 2, [3, 3]), (4, 2, [3]), (5, None, [3, 4]), (6, 2, None), (None, 2, [3, 4]), (7, 2, [3, 3, 99]), (8, 3, [1 << 40, 1 << 40])]
    assert found(spark, rows, [r for r in rows if r[0] in (0, 8)]) == slow(rows, [r for r in rows if r[0] in (0, 8)])
    assert found(spark, [], []) == [] and found(spark, rows, []) == []


def test_rows_that_take_no_part(spark, tmp_path):
    """Null labels and vectors, null and non-finite components, and other columns with clashing names."""
    inf, nan = float("inf"), float("nan")
    rows = [(i, 1 + i % 2, [0.5, 0.01 * i], 7) for i in range(1, 30)] + [(0, 1, [0.5, 0.5], 7), (100, None, [0.5, 0.5], 7), (200, 1, None, 7), (300, 1, [None, 0.5], 7), (400, 1, [inf, 0.5], None), (500, 1, [0.5, nan], 7)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, score int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    assert {r.anchor_id for r in out} == {0} and not {100, 200, 300, 400, 500} & {x for r in out for x in (r.positive_id, r.negative_id)}
