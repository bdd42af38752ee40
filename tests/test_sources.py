"""Scans and sinks round trip on small files of our own."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import readers as R
from corpusmill.sources import sinks as K
from corpusmill.streaming import ingest as I


def test_repo_stream(spark):
    file = "struct<file_path:string,language:string,license_type:string,file_timestamp:long,content:string>"
    rows = [("o/r", "c1", {"repo_created_at": "2020"}, [("a.py", "Python", "permissive", 5, "x = 1"), ("b.js", "JavaScript", "permissive", 5, ""), ("c.py", "python", "gpl", 5, ""), ("d.py", "python", "permissive", None, "<EMAIL>"), ("e.py", "python", "MIT", None, "y"), ("f.py", "python", "mit", 1, "z")])]
    frame = spark.createDataFrame(rows, f"repo_path string, commit_id string, github_metadata struct<repo_created_at:string>, files array<{file}>")
    assert sorted(r.path for r in R.repo_stream(frame, min_file_ts=3).collect()) == ["a.py", "e.py"]


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "own__er__pkg__mod.py").write_bytes(b"x = '\xff'")
    (tmp_path / "plain.py").write_text("y = 1")
    (tmp_path / "no.txt").write_text("n")
    got = {(r.repo, r.path): r.content for r in R.directory(spark, str(tmp_path)).collect()}
    assert got == {("own/er", "pkg/mod.py"): "x = '�'", ("local", "plain.py"): "y = 1"}


def test_mapped(spark):
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "n int, body string")
    assert [r.content for r in R.mapped(rows, {"content": "body"}, skip=3, order="n").collect()] == ["c3", "c4"]


def test_mapped_skips_for_each_source(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 2 else f"s{i % 3}", f"c{i}") for i in range(12)], "n int, source string, body string")
    assert sorted(r.content for r in R.mapped(rows, {"content": "body"}, skip=3, order="n", by="source").collect()) == ["c10", "c11", "c9"]
    assert R.mapped(rows, {"content": "body"}, skip=20, order="n").count() == 0


def test_a_file_of_many_splits_has_the_lines_of_one(spark, tmp_path):
    """Empty lines, lines longer than a split, carriage returns and a last line without an end."""
    rng = random.Random(3)
    texts = {}
    for name in ("a.jsonl", "b.jsonl"):
        values = ["" if rng.random() < 0.2 else "é" * rng.randrange(200) + str(i) + ("\r" if i % 7 == 0 else "") for i in range(400)]
        (tmp_path / name).write_bytes("\n".join(values).encode())
        texts[name] = values
    with gzip.open(tmp_path / "c.jsonl.gz", "wb") as f:
        f.write("\n".join(texts["a.jsonl"]).encode() + b"\n")
    want = sorted((i, n, v) for i, name in enumerate(("a.jsonl", "b.jsonl", "a.jsonl")) for n, v in enumerate(texts[name]) if v)
    for size in ("128m", "97"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            lines = R.jsonl(spark, str(tmp_path))
            assert sorted((r.shard, r.line, r.value) for r in lines.collect()) == want
            assert size == "128m" or spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 50
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_jsonl_identity_and_selective_parse(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 3}\n{"_meta": 1}\nnot json\n')
    lines = R.jsonl(spark, str(tmp_path))
    assert sorted((r.shard, r.line) for r in lines.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    wanted = spark.createDataFrame([(0, 0), (1, 1)], "shard long, line long")
    assert sorted((r.shard, r.line, r.a) for r in R.wanted_lines(lines, wanted, "a int").collect()) == [(0, 0, 3), (1, 1, 2)]
    assert R.receipts(lines.where("value <> 'not json'")).count() == 3


def test_shard_names_fail_closed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.finalized(spark, str(tmp_path))
    for n in ("triples_ast_0001.jsonl", "triples_ast_0001_raw.jsonl", "triples_exec.jsonl", "triples_usage.jsonl", "qa_pairs_0000.jsonl"):
        (tmp_path / n).write_text("")
    assert R.finalized(spark, str(tmp_path)) == ["triples_ast_0001.jsonl", "triples_exec.jsonl"]
    with pytest.raises(FileNotFoundError):
        R.paired_shards(spark, str(tmp_path))
    (tmp_path / "qa_pairs_meta_0000.jsonl").write_text("")
    assert R.paired_shards(spark, str(tmp_path)) == [("qa_pairs_0000.jsonl", "qa_pairs_meta_0000.jsonl")]


def test_frozen(spark, tmp_path):
    path = tmp_path / "bank.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert R.frozen(spark, str(path), digest, 2).count() == 2
    with pytest.raises(ValueError):
        R.frozen(spark, str(path), digest, 3)
    path.write_text('{"a": 1}\n{"a": 3}\n')
    with pytest.raises(ValueError):
        R.frozen(spark, str(path), digest, 2)


def test_rolling_and_pairs_and_rejects(spark, tmp_path):
    rows = spark.range(25).select("id", F.lit("x").alias("v"), F.lit("p").alias("pile"), F.when(F.col("id") % 5 == 0, "dup").otherwise("kept").alias("status")).coalesce(1)
    K.rolling_json(rows, str(tmp_path / "r"), per_file=10)
    sizes = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "r").glob("*.json"))
    assert sizes == [5, 10, 10]
    K.rolling_json(rows.limit(3), str(tmp_path / "r"), per_file=10)
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    K.shard_pair(rows, str(tmp_path / "s"), ["v"], ["status"], "id")
    assert spark.read.json(str(tmp_path / "s/pairs")).join(spark.read.json(str(tmp_path / "s/meta")), "id").count() == 25
    K.rejects(rows, str(tmp_path / "j"), ("kept",))
    assert {r.reason for r in spark.read.json(str(tmp_path / "j")).collect()} == {"dup"}


def test_declared_schema(spark, tmp_path):
    row = {"repo": "r", "path": "p", "func_name": "f", "code": "c", "n_tokens": 3, "qualified": "q", "span": [0, 4], "is_method": False, "is_async": False, "decorated": False, "has_docstring": False, "typed": True, "string_share": 0.5, "n_strings": 1, "source": "s", "file_ts": None, "commit_id": None, "repo_created": None, "split": "train"}
    frame = spark.createDataFrame([row], K.CORPUS + ", split string")
    K.corpus_dataset(frame, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert len(back.columns) == 19 and back.first().span == [0, 4] and (tmp_path / "c" / "split=train").exists()
    K.partitioned(frame, str(tmp_path / "d"), "source", "split")
    assert (tmp_path / "d" / "source=s" / "split=train").exists()


def test_publish_is_atomic(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    K.publish(spark, spark.range(5), path, {"none negative": lambda d: d.where("id < 0")})
    with pytest.raises(ValueError):
        K.publish(spark, spark.range(9), path, {"none": lambda d: d.where("id > 3")})
    with pytest.raises(ValueError):
        K.publish(spark, spark.range(0), path, {})
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "out.new").exists()
    (tmp_path / "out").rename(tmp_path / "out.old")  # as after a publisher that died between its renames
    with pytest.raises(ValueError):
        K.publish(spark, spark.range(9), path, {"none": lambda d: d.where("id > 3")})
    assert spark.read.parquet(path).count() == 5
    K.publish(spark, spark.range(7), path, {})
    assert spark.read.parquet(path).count() == 7 and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["out"]


def test_freeze(spark, tmp_path):
    rows, path = spark.createDataFrame([(2, "é"), (1, "b")], "k int, v string"), str(tmp_path / "f.jsonl.gz")
    assert K.freeze(rows, path, "k") and K.freeze(rows, path, "k", check=True) and not K.freeze(rows.limit(1), path, "k", check=True)
    with pytest.raises(FileExistsError):
        K.freeze(rows, path, "k")
    assert [json.loads(x)["k"] for x in gzip.open(path, "rt").read().splitlines()] == [1, 2]
    assert "| k | v |" in K.markdown("t", {"rows": rows})


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    schema = "doc_id long, text string"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return I.run_to_parquet(spark, I.seen_hashes(stream), "t", checkpoint=checkpoint, out=out)

    spark.createDataFrame([(1, "a"), (2, "b"), (3, " a ")], schema).coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    assert sorted(r.text.strip() for r in run().collect()) == ["a", "b", "c"]
    assert run().count() == 3


def test_ledger_skips_what_is_done(spark, tmp_path):
    source, done, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "done", "cp"))
    schema = "k long, v string"
    for batch in ([(1, "a"), (2, "b")], [(2, "again"), (3, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        I.with_ledger(spark, spark.readStream.schema(schema).parquet(source), done, "k", lambda f: f, checkpoint)
    assert sorted((r.k, r.v) for r in spark.read.parquet(done).select("k", "v").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_restarted_cap_goes_on_counting(spark, tmp_path):
    """Five batches through a query that is stopped after each; a key's rows of a batch come in several frames."""
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    schema, kept, had = "doc_id long, source string", [], {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for batch in range(5):
            rows = [(100 * batch + (i * 37) % 100, f"s{i % 3 if i < 60 else 0}") for i in range(100)]
            spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            I.run_to_parquet(spark, I.capped_repos(stream, "source", 70), "cap", checkpoint=checkpoint, out=out)
            for key in ("s0", "s1", "s2"):
                own = sorted(d for d, s in rows if s == key)[: 70 - had.get(key, 0)]
                had[key] = had.get(key, 0) + len(own)
                kept += [(d, key) for d in own]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc_id, r.source) for r in spark.read.parquet(out).collect()) == sorted(kept) and max(had.values()) == 70


def test_a_batch_reads_nothing_that_earlier_ones_wrote(spark, tmp_path, monkeypatch):
    source, done, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "done", "cp"))
    schema, plans = "k long, v string", []

    def work(frame):
        plans.append(frame._jdf.queryExecution().toString())
        return frame

    for batch in range(4):
        spark.createDataFrame([(i, f"b{batch}") for i in range(batch * 5, batch * 5 + 8)] + [(batch * 5 + 7, "twice")], schema).coalesce(1).write.mode("append").parquet(source)
        I.with_ledger(spark, spark.readStream.schema(schema).parquet(source), done, "k", work, checkpoint)
    rows = spark.read.parquet(done).groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("v")).collect()
    assert {(r.k, r.n, r.v) for r in rows} == {(k, 2 if k % 5 == 2 and k >= 7 else 1, f"b{0 if k < 8 else (k - 3) // 5}") for k in range(23)}
    assert len(plans) == 4 and not any("/done" in p for p in plans)


def test_valid_prefix(spark):
    lines = spark.createDataFrame([(0, "{}"), (1, '{"a": 1}'), (2, '{"a"'), (3, "{}")], "line long, value string")
    assert sorted(r.line for r in I.valid_prefix(lines).collect()) == [0, 1]
