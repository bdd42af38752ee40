import random

import numpy as np
import xxhash

from corpusmill.llm import simhash as S
from corpusmill.llm.common import words_of


def slow_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fps: (doc_id, fingerprint)"""
    label = {d: d for d, _ in fps}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {d: root(d) for d, _ in fps}


def check(spark, docs, **more):
    texts = sorted({(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()}, key=lambda x: x[0])
    fps = [(d, slow_fingerprint(t)) for d, t in texts]
    want = slow_components(fps)
    rows = S.near_duplicates(spark, docs, **more).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == dict(fps)[r.doc_id]
            assert r.component_id == want[r.doc_id]
    return rows


def test_against_brute_force(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def test_chain_and_hot_shards(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(spark, docs)
    check(spark, docs, shard_rows=5)  # every shard is dealt again


def test_forest_finds_all_links():
    rng = np.random.default_rng(7)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 62, 300), (1 << 40) + rng.integers(0, 256, 300)]).astype(np.uint64))
    shard = rng.integers(0, 3, len(fps))
    found = {(int(a), int(b)) for x, y in S.BKForest(shard, fps).links(3) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if shard[i] == shard[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert found == want


def test_odd_rows(spark, odd, empty):
    rows = check(spark, odd)
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert S.near_duplicates(spark, empty).count() == 0
    kept = S.deduplicated(spark, odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 8]


def test_whole_last_word_and_long_link(spark):
    docs = spark.createDataFrame([(5, "One two"), (9, "one TWO"), (7, "other")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in check(spark, docs)} == {5: 5, 9: 5, 7: 7}


def test_components_run_no_round_more_than_needed(spark, monkeypatch):
    """Stars are taken as they are, and each round's leavings are released before the next."""
    wrote, freed = [], []
    monkeypatch.setattr(S, "stored", lambda *a, f=S.stored: (wrote.append(1), f(*a))[1])
    monkeypatch.setattr(S, "release", lambda *a, f=S.release: (freed.append(1), f(*a))[1])
    path = [(i + 1, i) for i in range(40)]
    cases = [([], 0), ([(2, 1), (3, 1), (3, 1), (9, 4)], 0), ([(2, 1), (3, 2)], 1), ([(3, 1), (3, 2)], 1), (path, None), ([(max(x), min(x)) for x in ((i * 17 % 41, (i + 1) * 17 % 41) for i in range(40))], None)]
    for edges, rounds in cases:
        wrote.clear(), freed.clear()
        got = sorted(map(tuple, S.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
        label = {x: x for e in edges for x in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert got == sorted((x, c) for x, c in label.items() if x != c)
        assert len(freed) == len(wrote) - 1
        assert rounds is None or len(wrote) - 1 == rounds
