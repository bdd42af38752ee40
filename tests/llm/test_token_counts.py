import random
from functools import lru_cache

from corpusmill.llm import token_counts as K
from corpusmill.llm.common import words_of


def slow_count(pieces, word):
    """Best (score, -tokens) over all segmentations, one word at a time and without a trie."""
    text, worst = K.MARK + word, min(pieces.values()) - 10.0

    @lru_cache(maxsize=None)
    def best(end):
        if end == 0:
            return (0.0, 0)
        size = len(text[end - 1].encode())
        s, n = best(end - 1)
        options = [(s + size * worst, n - size)]
        for start in range(end):
            if text[start:end] in pieces:
                s, n = best(start)
                options.append((s + pieces[text[start:end]], n - 1))
        return max(options)

    return -best(len(text))[1]


def test_against_segmentation_without_a_trie(spark, sf):
    pieces = K.vocabulary()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in K.token_counts(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    known = {}
    for doc_id in sorted(texts)[::8]:
        words = words_of(texts[doc_id])
        for w in set(words) - known.keys():
            known[w] = slow_count(pieces, w)
        assert (rows[doc_id].n_pretokens, rows[doc_id].n_tokens) == (len(words), sum(known[w] for w in words))


def test_any_grouping_counts_alike():
    pieces = {K.MARK: -1.0, "a": -2.0, "ab": -2.5, "b": -2.0, "abab": -4.0, K.MARK + "a": -2.2}
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["a" * 5000]
    want = {w: slow_count(pieces, w) for w in words[:-1]}
    trie = K.Trie(pieces)
    got = trie.counts(words[:100]) | trie.counts(words[100:])
    assert got.pop("a" * 5000) == 5000 and got == want


def test_shared_prefixes_are_scored_once():
    trie = K.Trie({K.MARK: -1.0, "a": -1.0})
    trie.counts(["aab", "aaa", "aaab"])
    assert trie.scored == 6  # the mark, a, a, a, b below aaa, b below aa


def test_known_words_may_be_forgotten(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(K.token_counts(docs).collect())
    monkeypatch.setattr(K, "KNOWN", 50)
    monkeypatch.setattr(K, "CHUNK", 1000)
    assert sorted(K.token_counts(docs).collect()) == want


def test_odd_rows(spark, odd, empty):
    rows = K.token_counts(odd).collect()
    assert len(rows) == 10
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert K.token_counts(empty).count() == 0
