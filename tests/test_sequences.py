"""Sequence comparison against the definitions, and the queries that use it against plain Python on whole texts."""

import difflib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.functions import sequences as Q
from corpusmill.plans.registry import QUERIES, table


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


few = st.lists(st.sampled_from("abc"), max_size=40)


@given(few, few)
@settings(max_examples=300, deadline=None)
def test_bits_give_the_table(a, b):
    assert Q.common_subsequence(a, b) == slow_common(a, b)


@given(few, few)
@settings(max_examples=300, deadline=None)
def test_blocks_are_those_of_the_definition_with_its_ties(a, b):
    joined = []
    for i, j, n in Q.matching_blocks(a, b):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    assert joined == [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


def test_edges():
    assert Q.rouge_l([], ["a"]) == Q.rouge_l(None, ["a"]) == 0.0 and Q.rouge_l(["a"], ["a"]) == 1.0
    assert Q.ratio("", "") == 1.0 and Q.ratio(None, "") is None and Q.ratio("a", "") == 0.0


def test_long_sequences_take_little_time():
    rng = random.Random(4)
    a = [rng.randrange(500) for _ in range(20_000)]
    b = list(a)
    for i in rng.sample(range(len(b)), 2_000):
        b[i] = rng.randrange(500)
    assert 18_000 <= Q.common_subsequence(a, b) <= 20_000
    assert 0.9 <= Q.ratio(a[:4_000], b[:4_000]) < 1


def test_rouge_of_whole_turns(spark, sf):
    turns = {(r.conv_id, r.turn): r for r in table(spark, sf, "conversations").collect()}
    tokens = lambda t: re.findall("[a-z0-9_]+", t.lower())
    n = 0
    for r in QUERIES["rouge_l_pairs"](spark, sf).collect():
        a, b = (tokens(turns[r.conv_id, r.turn + i].text) for i in (0, 1))
        assert abs(r.f1 - (2 * slow_common(a, b) / (len(a) + len(b)) if a and b else 0.0)) < 1e-12
        n += len(a) > 12
    assert n


def test_similarity_of_whole_documents(spark, sf):
    """Every document of the table, against the slow matcher."""
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["sequence_similarity"](spark, sf).collect():
        text = docs[r.doc_id]
        if text is None:
            assert r.sim is None
            continue
        half = len(text) // 2
        edited = (re.sub(r"( |\n)t[a-z]+", r"\1that", text), text[half:] + text[:half], text.lower(), text + "x")[r.doc_id % 4]
        assert r.sim == slow_ratio(text, edited)
