"""Rows that share a doc_id, with one text or several, through the operators that work by doc_id."""

from corpusmill.llm import mixing, near_copies, simhash
from corpusmill.llm import substring_dedup as S

LONG = " ".join(f"w{i}" for i in range(80))
OTHER = " ".join(f"v{i}" for i in range(60))


def test_near_dedup_keeps_both_texts_of_an_id(spark):
    rows = [(5, LONG, "a"), (5, OTHER, "a"), (5, OTHER, "b"), (5, OTHER, "b"), (2, LONG + " tail", "c"), (9, OTHER, "d"), (None, LONG, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for find in (near_copies.groups, simhash.near_duplicates):
        for table in (docs, docs.orderBy("lang", ascending=False)):
            out = sorted((r.doc_id or 0, r.text, r.lang) for r in simhash.deduplicated(spark, table, find).collect())
            assert [(d, t) for d, t, _ in out] == [(0, LONG), (2, LONG + " tail"), (5, OTHER)]
            assert out[2][2] == sorted(simhash.deduplicated(spark, docs, find).where("doc_id = 5").collect())[0].lang  # the same row each time


def test_components_of_an_id_with_two_texts(spark):
    docs = spark.createDataFrame([(5, LONG), (5, OTHER), (2, LONG), (7, OTHER)], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()}
    assert found == {(5, 2), (2, 2), (5, 5), (7, 5)}


def test_substring_dedup_of_an_id_with_two_texts(spark):
    """A row loses only words of its own."""
    rows = [(1, LONG), (2, "short text"), (2, "x " + LONG), (2, LONG), (3, OTHER), (3, OTHER)]
    out = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, 80, 0), (2, 2, 0), (2, 80, 80), (2, 81, 80), (3, 60, 0), (3, 60, 0)]


def test_mixing_with_clashing_columns(spark):
    names = ["more", "target", "source_size", "whole", "last_cell", "last_key", "plan_source", "doc_key", "repeats", "taken", "Size", "weight", "cell"]
    rows = [(i, f"a b c d{i}", "s" if i % 3 else "t", *range(len(names))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mixed_documents(spark, docs)
    added = {"size", "source_size", "target", "repeats", "taken"}
    assert out.columns == [c for c in docs.columns if c.lower() not in added] + ["size", "source_size", "target", "repeats", "taken"]
    plain = {r.doc_id: (r.size, r.repeats, r.taken) for r in mixing.mix(spark, docs.select("doc_id", "text", "source")).collect() if r.repeats}
    got = out.collect()
    assert {r.doc_id: (r.size, r.repeats, r.taken) for r in got} == plain and all((r.more, r.whole, r.last_key, r.cell) == (0, 3, 5, 12) for r in got)
