"""What the findings of round 4 on time ask: steps whose work grows with the text, each parsed or searched once."""

import difflib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import columns, sequences
from corpusmill.operators import similar


def test_long_questions_take_time_by_their_length(spark):
    """tokens are counted in one pass, not sorted anew for each token; pairs of questions are found from their marks."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{i}x{rng.randrange(2_000)}" for _ in range(3_000)]
        rows += [("A", f"a{i}", " ".join(words)), ("A", f"b{i}", " ".join([*words[:1_000], "changed", *words[1_001:]]))]
    frame = spark.createDataFrame(rows, "intent string, pair_id string, question string").repartition(8)
    began = time.time()
    got = {r.pair_id: r.cluster for r in similar.phrase_clusters(spark, frame).collect()}
    took = time.time() - began
    assert all(got[f"a{i}"] == got[f"b{i}"] in (f"a{i}", f"b{i}") for i in range(60))
    assert took < 50, took


def test_files_are_dealt_out_before_they_are_parsed(spark, sf):
    """a table of one row group is more than one task."""
    from corpusmill.plans import code

    assert code.files(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_trainer_pairs_parses_each_function_once(spark, sf):
    """yes and no come from one pass."""
    from corpusmill.plans.registry import QUERIES

    plan = QUERIES["trainer_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_events_are_summed_in_their_batches(spark, sf):
    """F14, F16: a few rows a batch leave Python, not some eighty a function; an unread screening isn't done."""
    from corpusmill.operators import source
    from corpusmill.plans import code

    rows = code.rendered(spark, sf).coalesce(1)
    found = source.fact_events(rows, code.OTHER_DOCS, ("A1", "A2")).collect()
    assert rows.count() > 10 >= len(found)
    assert {r.n for r in found if r.event == "applicable" and r.intent == "A1"} == {rows.count()}
    assert not [r for r in source.fact_events(rows, code.OTHER_DOCS, ("A1",), screened=False).collect() if r.event == "screened"]


def test_a_function_is_parsed_once(monkeypatch):
    """F14, F16, F17, F22: the tree that shows that a text parses is the one that facts are read from."""
    from corpusmill.functions import facts, pysource

    calls, plain = [], pysource.quiet_parse
    monkeypatch.setattr(pysource, "quiet_parse", lambda code: calls.append(code) or plain(code))
    monkeypatch.setattr(facts, "quiet_parse", pysource.quiet_parse, raising=False)
    assert facts.extract_facts("def f(a):\n    return a", "m.f", "f", False, None, ("A1",))
    assert len(calls) == 1


def test_slices_of_a_batch_lose_no_row(spark, sf, monkeypatch):
    """a batch becomes Python objects a slice at a time."""
    from corpusmill.operators import source

    monkeypatch.setattr(source, "SLICE", 2)
    rows = spark.createDataFrame([(i, f"def f{i}(): pass") for i in range(7)], "id long, content string").coalesce(1)
    assert sorted((r.id, r.name) for r in source.extract_functions(rows, ["id"]).collect()) == [(i, f"f{i}") for i in range(7)]


def test_texts_that_repeat_short_runs_take_time_by_their_length():
    """thousands of blocks of one length are not searched for one by one."""
    rng = random.Random(6)
    words = ["".join(rng.choices("ABCDEFGH", k=rng.randrange(2, 9))) for _ in range(400)]
    text = "!! ".join(rng.choice(words) for _ in range(6_000))
    began = time.time()
    assert 0 < sequences.ratio(text, text.lower()) < 1
    took = time.time() - began
    assert took < 5, took


@pytest.mark.parametrize("limits", [{}, {"WORDS": (2, 3, 5, 9), "COMMON": 3, "TINY": 0}, {"WORDS": (2, 3, 5, 9), "COMMON": 3, "TINY": 20, "PLACES": 1, "WHOLE": 6}])
def test_every_way_to_find_blocks_gives_those_of_the_definition(monkeypatch, limits):
    """by words, by lengths, by places and by automaton, on texts that repeat themselves."""
    for name, value in limits.items():
        monkeypatch.setattr(sequences, name, value)
    rng = random.Random(7)
    for n in range(300):
        lines = ["".join(rng.choices("abB ", k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6))]
        a = "".join(rng.choice(lines) for _ in range(rng.randrange(40)))
        b = (a.lower(), a[len(a) // 2 :] + a[: len(a) // 2], "".join(c for c in a if rng.random() < 0.95), "".join(rng.choice(lines) for _ in range(30)))[n % 4]
        for x, y in ((a, b), (list(a), list(b))):
            blocks = [tuple(m) for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()[:-1]]
            joined = []
            for i, j, size in sequences.matching_blocks(x, y):
                if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                    joined[-1] = (*joined[-1][:2], joined[-1][2] + size)
                else:
                    joined.append((i, j, size))
            assert joined == blocks, (x, y)


def test_white_space_is_stripped_at_the_ends_alone(spark):
    """what a search for white space all through the text gave."""
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() or c in (0x180E, 0x200B, 0xFEFF)]
    texts = [f"{s}{t}a {s}é{s}" for s in spaces for t in ("", "\n \u3000")] + ["", " \t", "a", "\n\na\r\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", columns.stripped("t").alias("new"), F.regexp_replace("t", r"(?U)^\s+|\s+\z", "").alias("old")).collect()
    assert not [r for r in got if r.new != r.old]
    assert "regexp" not in rows.select(columns.content_hash("t"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_draw_reads_each_text_once(spark, sf, monkeypatch):
    """lengths and families come from one pass, without a digest that the draw doesn't use."""
    from corpusmill.plans import corpus

    written = []
    monkeypatch.setattr(corpus, "stored", lambda spark, frame, name, *by, plain=corpus.stored: written.append(frame) or plain(spark, frame, name, *by))
    corpus.drawn(spark, sf)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in written]
    assert sum("text#" in p for p in plans) == 1 and "".join(plans).count("regexp_extract_all(") == 1 and "regexp_count" not in "".join(plans)


def test_the_rarest_tokens_are_found_where_texts_are_read(spark):
    """with few, some or all counts known to the tasks; texts that are settled there meet no counts."""
    from corpusmill.operators import training

    rng = random.Random(8)
    texts = {i: " ".join(f"{'abcdefghij'[min(int(rng.expovariate(0.5)), 9)]}{'x' * rng.randrange(3)}" for _ in range(rng.randrange(60))) for i in range(40)}
    counted = Counter(w for t in texts.values() for w in t.split())
    want = {(i, p + 1, t.split()[p]) for i, t in texts.items() for p in sorted(range(len(t.split())), key=lambda p: (counted[t.split()[p]], -p))[: len(t.split()) // 10]}
    docs = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string")
    counts = spark.createDataFrame([*counted.items()], "token string, n long")
    for known in (1, 8, 100_000):
        got = [tuple(r) for r in training.rarest(spark, docs, counts, known).collect()]
        assert len(got) == len(want) and set(got) == want
