"""Cards and styles: every fact has a prompt, slots are filled, styles are even."""

import json
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.functions import facts
from corpusmill.operators import phrasing as H
from corpusmill.operators import source as S
from corpusmill.plans import code


def test_every_intent_has_a_card():
    assert set(facts.INTENTS) <= set(H.CARDS) and {f"I{i}" for i in range(1, 7)} | {f"D{i}" for i in range(1, 8)} <= set(H.CARDS)
    assert len(set(H.CARDS.values())) == len(H.CARDS) and all(t.count("{x}") == 1 for t in H.STYLES.values())


def test_every_fact_has_a_prompt_with_its_slots(spark, sf):
    found = S.extract_facts(code.rendered(spark, sf), ["p_partkey"], pool=code.OTHER_DOCS).unionByName(S.extract_facts(code.methods(spark, sf), ["p_partkey"], pool=code.OTHER_DOCS))
    rows = H.phrased(found, F.concat_ws("|", "p_partkey", "intent", "seed")).collect()
    assert len({r.intent for r in rows}) > 30
    for r in rows:
        seed = json.loads(r.seed)
        want = H.CARDS[r.intent]
        for slot in ("param", "feature", "count_of", "callee", "construct", "k", "n", "var", "property", "line", "aspect", "exit_kind", "situation"):
            want = want.replace("{%s}" % slot, str(seed.get(slot, "")))
        assert r.clause == want.strip() and r.prompt == H.STYLES[r.style].replace("{x}", r.clause) and "{" not in r.prompt.replace(str(seed), "")
    spread = Counter(r.style for r in rows)
    assert set(spread) == set(H.STYLES) and max(spread.values()) < 1.3 * min(spread.values())


def test_unknown_intents_and_null_seeds(spark):
    rows = spark.createDataFrame([("A4", None), ("Z9", "{}"), (None, "{}")], "intent string, seed string")
    got = {r.intent: (r.clause, r.prompt is None) for r in H.phrased(rows, F.lit("k")).collect()}
    assert got == {"A4": ("what  is when the caller leaves it out", False), "Z9": (None, True), None: (None, True)}
