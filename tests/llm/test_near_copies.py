import os
import random

import corpus_pipeline as P
from corpusmill.llm import near_copies as N
from corpusmill.llm.common import words_of


def slow_set(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_groups(texts):
    """texts: (doc_id, text); all pairs by exact similarity."""
    sets, label = {d: slow_set(t) for d, t in texts}, {d: d for d, _ in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            small, large = sorted((len(x), len(y)))
            if 5 * small >= 4 * large and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {d: root(d) for d in ids}


def check(spark, docs, **more):
    want = slow_groups([(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()])
    assert {r.doc_id: r.component_id for r in N.groups(spark, docs, **more).collect()} == want
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs.where("doc_id IS NOT NULL"), "").collect()) == sorted(set(want.values()))
    return want


def edited(words, n, rng):
    copy = list(words)
    for at in rng.sample(range(len(copy)), n):
        copy[at] = f"x{rng.randrange(10**6)}"
    return " ".join(copy)


def test_the_stage_links_at_the_threshold_and_only_there(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(3 * i + 1, " ".join(base)), (3 * i + 2, edited(base, 2, rng)), (3 * i + 3, edited(base, 3 + i % 6, rng))]
    # just below and at 0.8: 8 of 9 shingles of each (8/10), 7 of 8 (7/9)
    rows += [(200, "a b c d e f g h i j k l m"), (201, "A b c d e f g h i j k l z"), (210, "n o p q r s t u v w x y"), (211, "n o p q r s t u v w x z")]
    want = check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert want[201] == 200 and want[211] == 211 and len(set(want.values())) < len(rows) - 40


def test_a_large_cluster_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = spark.createDataFrame([(i + 1, edited(base, rng.randrange(6), rng)) for i in range(150)], "doc_id long, text string")
    check(spark, docs, block=16)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{os.environ.get('NEAR_SF_DIR', sf)}/documents.parquet")
    check(spark, docs)


def test_odd_rows(spark, odd, empty):
    found = {r.doc_id: r.component_id for r in N.groups(spark, odd).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8}
    assert N.groups(spark, empty).count() == 0
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, odd, "").collect()) == [0, 1, 3, 6, 8]
