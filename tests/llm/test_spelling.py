import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import spelling as S
from corpusmill.llm.queries import QUERIES


def slow_near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts, ratio=5):
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((x for x in counts if slow_near(w, x)), key=lambda x: (-counts[x], x))
        best = near[0] if near and counts[near[0]] >= ratio * n else None
        form[w] = best
        out[w] = (best, n, len(near), counts[best] if best else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def slow_words(rows, noise=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def got(frame):
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made_up(seed, n):
    """Words of few letters, so that many are near, with counts of a wide range."""
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 10)))
        words.add(w)
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            words.add(w[:i] + w[i] + w[i:])  # doubled: one word at several positions
    return {w: rng.choice((5, 5, 6, 25, 30, 125, 130, 700)) for w in words}


def test_wavelet_tree_reports_ranges():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 100):
        values = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 200) for _ in "abcd")
        which, value = S.WaveletTree(values).report(a, b, c, d)
        want = sorted((i, v) for i in range(200) for v in values[a[i] : b[i]].tolist() if c[i] <= v < d[i])
        assert sorted(zip(which.tolist(), value.tolist())) == want


@pytest.mark.parametrize("shard_words", [S.SHARD_WORDS, 100, 3])
def test_variants_against_brute_force(spark, shard_words):
    counts = made_up(1, 500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(S.variants(spark, words, shard_words=shard_words)) == slow_variants(counts)


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = slow_variants(slow_words(rows))
    assert got(QUERIES["op11_spelling_variants"](spark, sf)) == want
    assert any(v[0] for v in want.values())


def test_chain_of_forms_ends_at_the_last(spark):
    counts = {"abcdefg" + "x" * i: 5 ** (i + 1) for i in range(9)}
    found = got(S.variants(spark, spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {v[1] for v in found.values()} == {"abcdefg" + "x" * 8}
    assert found == slow_variants(counts)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(S.spelling_variants(spark, odd, noise=199)) == slow_variants(slow_words(rows))
    assert S.spelling_variants(spark, empty).count() == 0


def test_very_long_word_and_ties(spark):
    long = "ab" * 4_000
    rows = [(1, " ".join([long] * 25 + [long + "c"] * 5 + ["plains"] * 5 + ["plainx"] * 25 + ["plaint"] * 25)), (1, None), (None, "plains")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(S.spelling_variants(spark, docs))
    assert found[long + "c"] == (long, long, 5, 1, 25) and found[long] == (None, long, 25, 1, None)
    assert found["plains"] == (None, "plains", 6, 2, None)
    assert found["plainx"] == (None, "plainx", 25, 2, None)
