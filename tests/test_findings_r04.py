"""Round 4: planted terms, streams of tables in folders, spans and pairs over large groups."""

from corpusmill.plans.registry import QUERIES


def test_planted_trivial_words_are_caught(spark, tmp_path):
    rows = [(1, 0, "user", "which branch"), (1, 1, "assistant", "the then branch"), (2, 0, "user", "which"), (2, 1, "assistant", "the Else"), (3, 0, "user", "which"), (3, 1, "assistant", "is lorem")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in QUERIES["planted_leak_recall"](spark, str(tmp_path)).collect()] == [(3, 3)]


def test_a_table_of_several_files_streams_whole(spark, tmp_path):
    rows = [(1, "a", "en"), (2, "a", "de"), (3, "b", "en"), (4, "b ", "en"), (5, "c", "de"), (6, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.lang: r.n for r in QUERIES["stream_dedup_counts"](spark, str(tmp_path)).collect()} == {"en": 2, "de": 3}


def test_a_cap_over_several_files_keeps_the_first_of_the_table(spark, tmp_path):
    folder = str(tmp_path / "documents.parquet")
    for start in (100, 0, 50):
        spark.range(start, start + 50).selectExpr("id AS doc_id", "concat('s', id % 2) AS source").coalesce(1).write.mode("append").parquet(folder)
    got = QUERIES["stream_repo_cap"](spark, str(tmp_path)).collect()
    assert sorted((r.source, r.doc_id) for r in got) == [(f"s{k}", i) for k in range(2) for i in range(k, 60, 2)]


def test_the_ledger_makes_no_python_group_of_each_key(spark, tmp_path, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.delattr(PandasGroupedOpsMixin, "applyInPandasWithState")
    # one file a batch: an id that comes again in a later file is done already
    spark.range(300).selectExpr("id % 200 AS event_id", "concat('t', id % 2) AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r.n for r in QUERIES["stream_ledger"](spark, str(tmp_path)).collect()}
    assert sum(got.values()) >= 200 and set(got) == {"t0", "t1"}


def test_spans_ask_only_parents_up_to_their_own(spark):
    from corpusmill.operators import corpus as O

    head = b"the same first bytes of a large group, " * 9
    texts = [head + bytes([97 + i % 26]) * (i // 26 + 1) + b" end" for i in range(200)]
    files = spark.createDataFrame([(i, "k", t.decode()) for i, t in enumerate(texts)] + [(7, None, "x"), (8, "k", None)], "at long, k string, content string")
    spans = [(i, i, "k", len(head) - 50, len(head) + 1 + i % 5, bytearray(texts[(i * 7) % 200][len(head) - 50 : len(head) + 1 + i % 5])) for i in range(200)] + [(999, 9, None, 0, 1, bytearray(b"x"))]
    out = O.slice_at(spark, files, spark.createDataFrame(spans, "span_id long, at long, k string, start int, end int, code binary"), ["k"], upto="at")
    want = {i: (any(t[a:b] == bytes(code) for t in texts[: i + 1]), i + 1) for i, _, k, a, b, code in spans if k}
    assert {r.span_id: (r.ok, r.parents) for r in out.collect()} == want | {999: (False, 0)}
    assert {ok for ok, _ in want.values()} == {True, False}


def test_family_pairs_lose_no_link_between_different_texts(spark, tmp_path):
    rows = [(i, f"{'lorem' if i % 2 else 'ipsum'} dolor sit amet {i // 14}", "en", f"s{i % 3}") for i in range(28)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) AS long) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    of = {r.doc_id: r["class"] for r in QUERIES["family_classes"](spark, str(tmp_path)).collect()}
    pairs = {(r.a, r.b): (r.n_a, r.n_b) for r in QUERIES["family_pairs"](spark, str(tmp_path)).collect()}
    linked = {(min(of[i], of[j]), max(of[i], of[j])) for i in range(28) for j in range(i) if i % 3 != j % 3}
    assert set(pairs) == linked and sum(a * b for a, b in pairs.values()) == sum(i % 3 != j % 3 for i in range(28) for j in range(i))


def test_only_families_of_several_repositories_are_joined(spark, tmp_path, monkeypatch):
    from corpusmill.plans import corpus as P

    rows = [(i, "lorem " * (i + 10) + "dolor", "en", "s1") for i in range(40)] + [(90, "lorem ipsum dolor 1", "en", "s1"), (91, "lorem ipsum dolor 2", "en", "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) AS long) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    seen, plain = [], P.similar.similar_sets
    monkeypatch.setattr(P.similar, "similar_sets", lambda spark, rows: seen.append({r.id for r in rows.collect()}) or plain(spark, rows))
    QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()
    assert seen == [{90, 91}]
