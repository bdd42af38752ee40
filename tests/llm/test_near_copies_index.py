"""The candidates of near_dedup: SimHash words, shards and BK-trees."""

import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from test_near_copies import edited, slow_groups

from corpusmill.llm import near_copies as N
from corpusmill.llm import simhash


def test_words_are_simhash():
    rng = np.random.default_rng(1)
    for n in (4, 9, 24, 25, 300, 600):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        found = N.fingerprints(hashes)
        assert len(found) == (N.SMALL_WORDS if n <= N.SMALL else N.WORDS)
        for j in (0, len(found) - 1):
            of = [int(x) for x in N.mixed(hashes ^ N._SALT[j])]
            assert int(found[j]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in of) > n)


def slow_pairs(rows):
    """rows: shard, fp, rep, label, proof; a, b, n of every bucket by comparing all rows of a shard."""
    near = lambda x, y, most: ((x ^ y) & (1 << 64) - 1).bit_count() <= most
    at = list(range(len(rows)))
    for i, r in enumerate(rows):
        for j, q in enumerate(rows[:i]):
            if r[0] == q[0] and (r[3] == q[3] or near(r[1], q[1], N.RADIUS) and near(r[4], q[4], N.PROOF)):
                at = [min(at[i], at[j]) if k in (at[i], at[j]) else k for k in at]
    buckets = {}
    for k, (_, _, rep, label, _) in zip(at, rows):
        own = buckets.setdefault(k, {})
        own[label] = min(rep, own.get(label, rep))
    return sorted((a, min(b.values()), len(b)) for b in buckets.values() for a in b.values() if a != min(b.values()))


@pytest.mark.parametrize("joined", [False, True])
def test_buckets_are_what_bk_trees_join(monkeypatch, joined):
    built = []
    whole = simhash.BKForest.__init__
    monkeypatch.setattr(simhash.BKForest, "__init__", lambda self, *a: (built.append(1), whole(self, *a))[1])
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for shard, size, flips in ((1, 1, 0), (2, 2, 4), (3, 150, 4), (4, 150, 9), (5, 90, 30), (6, 5, 0), (7, 60, 0)):
        base = [rng.getrandbits(64) for _ in range(2)]
        proofs = [rng.getrandbits(64) for _ in range(3)]
        for _ in range(size):
            x, proof = rng.choice(base), rng.choice(proofs)
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
                proof ^= 1 << rng.randrange(64)
            rep = 1_000 - len(rows)
            rows.append((shard, signed(x), rep, rng.randrange(40) if joined and rng.random() < 0.5 else rep, signed(proof)))
    rows.sort()
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["shard", "fp", "rep", "label", "proof"])
    for batches in ([batch], [batch.slice(i, 37) for i in range(0, len(rows), 37)]):
        found = [r for b in N._shard_pairs(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["a"], r["b"], r["n"]) for r in found) == slow_pairs(rows)
    assert built


def test_unrelated_rows_of_a_large_shard_stay_apart():
    rng = np.random.default_rng(4)
    n = 5_000
    for shards in (1, 4):
        shard = np.sort(np.arange(n * shards) % shards)
        fp, proof = (rng.integers(-(1 << 63), 1 << 63, n * shards) for _ in "ab")
        fp &= ~0xFFFF  # the block that makes the shard
        order = np.lexsort((fp, shard))
        rep = rng.permutation(n * shards)
        a, _, size = N.bucket_pairs(shard, fp[order], rep, rep, proof)
        assert (size == 2).all() and len(a) <= 2 * shards


def missed(a, b, c):
    """Probability that sets of a and b hashes, c of them common, meet in no shard."""
    only = lambda n: [comb(n, k) / 2**n for k in range(n + 1)]
    x, y, p = only(a - c), only(b - c), 0
    for k, q in enumerate(only(c)):
        one = sum(u for i, u in enumerate(x) if 2 * (i + k) > a)
        other = sum(u for i, u in enumerate(y) if 2 * (i + k) > b)
        p += q * (one * (1 - other) + other * (1 - one))
    meet = (1 - p) ** 16 * sum(comb(48, k) * p**k * (1 - p) ** (48 - k) for k in range(N.RADIUS + 1))
    meet *= sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(N.PROOF + 1))
    return (1 - meet) ** (4 * (N.SMALL_WORDS if b <= N.SMALL else N.WORDS))


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    for b in [*range(4, 64), 90, 180, 360]:
        for a in range(b * 4 // 5, b + 1):
            c = next((c for c in range(a + 1) if 5 * c >= 4 * (a + b - c)), None)
            if c is not None:
                assert missed(a, b, c) < 5e-6, (a, b, c, missed(a, b, c))


def test_large_shards_are_dealt(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i + 1, edited(base, rng.randrange(6), rng)) for i in range(150)]
    found = N.groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=24).collect()
    assert {r.doc_id: r.component_id for r in found} == slow_groups(rows)


def test_joins_see_each_pair_of_a_document_and_a_first_once(spark, monkeypatch):
    """A large group of near copies shares many buckets with the same first documents."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i + 1, edited(base, rng.randrange(4), rng)) for i in range(60)]
    seen = []
    monkeypatch.setattr(N, "apart", lambda pairs, *a, f=N.apart: (seen.extend(map(tuple, pairs.collect())), f(pairs, *a))[1])
    found = N.groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == slow_groups(rows)
    assert seen and len(seen) == len(set(seen)) and all(a > b for a, b in seen)


def test_edges_grow_with_the_group(spark, monkeypatch):
    """Edges over all components of a group of near copies among other documents: fewer than four for each document, at any size of the group."""
    seen = []
    monkeypatch.setattr(N, "connected", lambda spark, edges, f=N.connected: (seen.append(edges.distinct().count()), f(spark, edges))[1])
    for n in (300, 1_200):
        rng = random.Random(n)
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows = [(i + 1, edited(base, rng.randrange(4), rng)) for i in range(n)]
        rows += [(n + i + 1, " ".join(f"w{rng.randrange(5_000)}" for _ in range(120))) for i in range(n // 2)]
        seen.clear()
        found = N.groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in found} == slow_groups(rows)
        assert sum(seen) < 4 * len(rows), seen


@pytest.mark.parametrize("few", [N.FEW, 0])
def test_both_ways_give_the_same_components(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW", few)
    rng = random.Random(1)
    edges = {tuple(sorted(rng.sample(range(400), 2), reverse=True)) for _ in range(260)}
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame([*edges, *edges], "a long, b long")
    assert {(r.node, r.component) for r in N.connected(spark, frame).collect()} == {(x, c) for x, c in label.items() if x != c}
    assert N.connected(spark, frame.limit(0)).count() == 0
