import hashlib
import random

import numpy as np

from corpusmill.llm import substring_dedup as D
from corpusmill.llm.common import words_of


def brute(docs):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    first = {}
    for doc_id, text in docs:
        words = words_of(text)
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text in docs:
        words = words_of(text)
        gone = set()
        for i in range(len(words) - 49):
            if doc_id is not None and first[tuple(words[i : i + 50])] < doc_id:
                gone |= set(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, docs, **more):
    rows = D.deduplicate(spark, docs, **more).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    return rows


def test_against_brute_force(spark, sf):
    rows = check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    assert any(r.n_removed for r in rows)


def test_passages_in_many_documents(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 120)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [word() for _ in range(rng.randrange(30))] + rng.choice(passages)
        docs.append((i * 7 % 61, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(check(spark, frame, batches=1))
    assert one == sorted(check(spark, frame, batches=7))  # runs, merges and compaction change nothing


def test_odd_rows(spark, odd, empty):
    rows = check(spark, odd)
    assert {r.doc_id: r.n_removed for r in rows}[7] == 20_000
    assert D.deduplicate(spark, empty).count() == 0


def test_rolling_hash_is_a_function_of_the_words():
    h = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x1234567890ABCDEF)
    assert (D.rolling(np.tile(h[:60], 5), 50)[60:71] == D.rolling(h[:60], 50)).all()
    assert len(D.rolling(h[:49], 50)) == 0 and len(np.unique(D.rolling(h, 50))) == 450


def test_an_index_that_lasts(spark, tmp_path):
    """Two calls on two halves give what one call on everything gives, in another object that opens the same folder."""
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(120))]
        rows.append((i, " ".join(words[:40] + rng.choice(passages) + words[40:]) if i % 2 else " ".join(words)))
    rows += [(60, rows[1][1]), (61, rows[59][1])]
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/index"
    got = {}
    for part in ("doc_id < 30", "doc_id BETWEEN 30 AND 50", "doc_id > 50"):
        for r in D.deduplicate(spark, docs.where(part), batches=2, index=D.WindowIndex(spark, folder)).collect():
            got[r.doc_id] = (r.n_words, r.n_removed, r.kept_sha256)
    assert got == brute(rows)
    index = D.WindowIndex(spark, folder)
    assert index.version > 6 and 1 <= len(index.runs) <= D.FAN_OUT
    # a batch moves, history doesn't: the only exchange of the plan is the batch's own
    batch = D.windows(D.keyed_rows(spark, docs.where("doc_id = 1")))
    owners = index.owners(batch)
    assert all(r.old for r in owners.collect())
    plan = owners._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]
    assert plan.count("Exchange ") == 1, plan
    assert plan.count("Bucketed: true") == len(index.runs), plan
