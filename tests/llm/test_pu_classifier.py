import zlib

import numpy as np

from corpusmill.llm import pu_classifier as P


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = P.classify(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(right) >= 0.93 * len(right)
    kept = {r.doc_id for r in P.accepted(spark, docs, labels).collect()}
    assert len(kept ^ {r.doc_id for r in rows if r.predicted}) <= 0.01 * len(rows)


def test_held_out_labels_are_never_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in P.classify(spark, docs, x).collect()} for x in (labels, flipped))
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_risk_stays_bounded_on_separable_data():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (2000, 8)).astype(np.float32), rng.normal(-1, 1, (600, 8)).astype(np.float32)
    mixed = np.concatenate([rng.normal(1, 1, (1400, 8)).astype(np.float32), bad])
    model = P.fit(good, mixed, 0.7)
    assert (model.scores(good) > 0.5).mean() > 0.95 and (model.scores(bad) < 0.5).mean() > 0.95


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = P.classify(spark, odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert P.classify(spark, empty, labels).count() == 0
    assert {r.score for r in P.classify(spark, odd, labels.where("false")).collect()} == {0.5}
    assert P.accepted(spark, odd, labels).columns == odd.columns


def test_the_prior_does_not_come_from_the_labels(spark):
    """Labelled rows are a biased pick (nearly all good); the prior of the unlabelled text is found within 0.05."""
    import random

    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choice("ETA01$#%") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    for true in (0.3, 0.6, 0.9):
        quality = [int(rng.random() < true) for _ in range(1200)]
        docs = spark.createDataFrame([(i, good() if q else bad()) for i, q in enumerate(quality)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality) if i % (2 if q else 40) == 0], "doc_id long, quality int")
        rows = P.sample(docs, labels, 10_000, 10_000).collect()
        x, place = ({p: np.array([of(r) for r in rows if r.positive == p]) for p in (True, False)} for of in (lambda r: P.features(r.text), lambda r: r.place))
        assert abs(P.estimated_prior(x[True], x[False], place[True], place[False]) - true) < 0.05


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i % 2}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] * 3, "doc_id long, quality int")
    rows = P.sample(docs, labels, 7, 11).collect()
    assert sum(r.positive for r in rows) <= 7 and sum(not r.positive for r in rows) <= 11
    every = P.sample(docs, labels, 1000, 1000).collect()
    assert sum(r.text.startswith("text") for r in every) in (0, 4) and len(every) == len({(r.positive, r.place) for r in every})


def slow_risk(w, bias, p, u, prior, decay):
    """The non-negative risk from its definition."""
    plus = lambda z: np.logaddexp(0, -z).mean()
    minus = lambda z: np.logaddexp(0, z).mean()
    zp, zu = p @ w + bias, u @ w + bias
    return prior * plus(zp) + max(0.0, minus(zu) - prior * minus(zp)) + decay / 2 * (w**2).sum()


def test_the_fit_has_the_least_risk():
    """No step from the fitted weights, in any of many directions, lowers the risk as its definition states it."""
    rng = np.random.default_rng(3)
    p, n = rng.normal(0.3, 1, (3000, 4)), rng.normal(-0.3, 1, (3000, 4))  # they overlap, so the negative part stays above zero
    u = np.concatenate([rng.normal(0.3, 1, (2000, 4)), n])
    model = P.fit(p.astype(np.float32), u.astype(np.float32), 0.4, rounds=3000, rate=0.005)
    to = lambda x: np.clip((x - model.mean) / model.scale, -8, 8)
    best = slow_risk(model.weights, model.bias, to(p), to(u), 0.4, 1e-3)
    for _ in range(200):
        step = rng.normal(0, 0.1, 5)
        assert slow_risk(model.weights + step[:4], model.bias + step[4], to(p), to(u), 0.4, 1e-3) > best - 1e-3


def test_the_driver_gets_the_model_only(spark, sf, monkeypatch):
    """Vectors are made and fitted in a task, to the model that their sample gives."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = sorted(P.sample(docs, labels, 300, 400).collect(), key=lambda r: r.place)
    x, place = ({p: np.array([of(r) for r in rows if r.positive == p]) for p in (True, False)} for of in (lambda r: P.features(r.text), lambda r: r.place))
    want = P.fit(x[True], x[False], P.estimated_prior(x[True], x[False], place[True], place[False]))

    def never(*_a, **_k):
        raise AssertionError("on the driver")

    for name in ("fit", "features", "estimated_prior"):
        monkeypatch.setattr(P, name, never)
    got = P.train(spark, docs, labels, 300, 400)
    assert np.allclose(got.weights, want.weights) and np.isclose(got.bias, want.bias) and np.array_equal(got.mean, want.mean) and np.array_equal(got.scale, want.scale)
