import pytest

from corpusmill.llm import mixing as M


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """Clamp and reshare until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def holds(rows):
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = slow_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_targets_and_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = M.mix(spark, docs).collect()
    assert len(rows) == docs.count()
    holds(rows)
    assert sorted(rows) == sorted(M.mix(spark, docs.repartition(5)).collect())


def test_hot_source_and_null_source(spark):
    rows = [(i, "w " * (i % 50), "big" if i % 3 else None) for i in range(900)] + [(1000 + i, "w w", f"s{i}") for i in range(20)]
    holds(M.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_odd_rows(spark, odd, empty):
    rows = M.mix(spark, odd).collect()
    assert len(rows) == 10
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert M.mix(spark, empty).count() == 0
    assert M.mixed_documents(spark, odd.drop("size"), ).where("taken > 2 * size").count() == 0
