import pytest
from test_mixing import slow_targets
from test_near_copies import slow_groups
from test_pii import slow_replacement

import corpus_pipeline as P
from corpusmill.llm import decontaminate, pii, pu_classifier
from corpusmill.llm.common import words_of


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        out.append(docs.collect())
    return out


def test_every_stage_takes_effect(spark, sf, steps):
    start, classified, single, clean, private, mixed = steps
    model = pu_classifier.train(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: model.scores(pu_classifier.features(r.text)[None])[0] for r in start}
    assert {r.doc_id for r in classified} == {d for d, s in score.items() if s >= 0.7}
    group = slow_groups([(r.doc_id, r.text) for r in classified])
    assert sorted(r.doc_id for r in single) == sorted(set(group.values()))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    squash = lambda x: " ".join((x or "").lower().split())
    held = {r.doc_id for r in single if any(squash(i) in squash(r.text) for i in items)}
    gone = {r.doc_id for r in single} - {r.doc_id for r in clean}
    block = decontaminate.Block(list(enumerate(items)))
    assert held and held <= gone == {r.doc_id for r in single if block.search([r.text])[0]}
    before = {r.doc_id: r.text for r in clean}
    want = dict(slow_replacement(list(before.items()), pii.session_key(spark)))
    assert {r.doc_id: r.text for r in private} == want != before and all(r.n_chars == len(r.text) for r in private)
    sizes = {}
    for r in private:
        sizes[r.source] = sizes.get(r.source, 0) + len(words_of(r.text))
    want = slow_targets(sizes)
    text = {r.doc_id: r.text for r in private}
    for r in mixed:
        assert r.text == text[r.doc_id] and r.target == pytest.approx(want[r.source]) and r.taken == r.repeats * r.size and 1 <= r.repeats <= 2


def test_columns_and_run(spark, sf, steps):
    first = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(rows[0].asDict()) == first for rows in steps[:-1])
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, steps[-1]))


def test_odd_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns
        P.mixed(spark, docs, sf).collect()
