import random

from corpusmill.llm import quality_rules as Q
from corpusmill.llm.common import words_of


def brute(text):
    words = words_of(text)
    n = len(words)
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def compare(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = Q.judge(spark, docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r.base_failed == failed and (not r.kept or not failed)
    return rows


def test_statistics_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = compare(spark, docs)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)


def test_repeats_with_overlaps(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 7, 8, 9, 40, 400)] + ["x " * 50, "a b c d e f g h\n" * 3]
    compare(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_odd_rows(spark, odd, empty):
    rows = Q.judge(spark, odd).collect()
    assert len(rows) == 10
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert Q.judge(spark, empty).count() == 0


def test_em_recovers_rates_and_accuracies():
    rng = random.Random(1)
    ways = (-1, -1, 1, 1)
    truth = [(0.02, 0.5), (0.05, 0.6), (0.8, 0.3), (0.7, 0.1)]
    counts = {}
    for _ in range(40_000):
        good = rng.random() < 0.75
        votes = tuple(w * (rng.random() < (g if good else b)) for w, (g, b) in zip(ways, truth))
        counts[votes] = counts.get(votes, 0) + 1
    prior, rates = Q.fit(sorted(counts.items()), ways)
    assert abs(prior - 0.75) < 0.03
    assert all(abs(x - y) < 0.05 for got, want in zip(rates, truth) for x, y in zip(got, want))
    acc = Q.accuracies(prior, rates, ways)
    assert all(0.5 < a <= 1 for a in acc)
    right = sum(n * (Q.posterior(v, prior, rates) >= 0.5) for v, n in counts.items() if v[:2] == (0, 0) and v[2:] == (1, 1))
    assert right == counts[0, 0, 1, 1] and Q.posterior((-1, -1, 0, 0), prior, rates) < 0.5


def test_fit_without_rows():
    prior, rates = Q.fit([], (-1, 1))
    assert prior == 0.8 and len(rates) == 2


def test_one_sign_of_junk_is_enough(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bad = [r.kept for r in Q.judge(spark, docs).collect() if label.get(r.doc_id) == 0]
    assert sum(bad) <= 0.4 * len(bad)


def slow_votes(text):
    """Which rules fire, from their meaning, on a text with words."""
    import re
    import unicodedata

    words, lines = words_of(text), [x for x in text.split("\n") if words_of(x)]
    n, base = len(words), brute(text)
    letters, symbols, repeats = base["word_chars"], base["n_symbols"], base["n_repeat_words"]
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    marks, stops = text.count("!"), len(re.findall(r"[.,;:?](?=[\x20\x09-\x0D]|$)", text))
    local = sum(len(set(words[i : i + 50])) for i in range(0, n, 50))
    return {
        "symbols": symbols > 0.1 * n, "repeats": repeats > 0.3 * n, "lines": len(lines) >= 4 and base["n_dup_lines"] > 0.3 * len(lines), "capitals": upper > 0.3 * letters,
        "marks": marks > 0.15 * n, "word_length": letters < 2 * n or letters > 15 * n, "variety": n >= 15 and local < 0.4 * n, "stops": n >= 40 and stops < 0.01 * n,
        "sentences": n >= 10 and 0.03 * n <= stops <= 0.4 * n and symbols <= 0.02 * n, "calm": 0.005 * letters <= upper <= 0.12 * letters and marks <= 0.02 * n and symbols <= 0.02 * n,
        "fresh": local >= 0.7 * n and repeats <= 0.05 * n and symbols <= 0.02 * n and marks <= 0.02 * n,
    }


def slow_posteriors(fired):
    """Expectation-maximisation document by document, two classes, each rule fires or not; Beta priors as documented."""
    good_rules = {"sentences", "calm", "fresh"}
    start = {r: (0.7, 0.3) if r in good_rules else (0.01, 0.3) for r in fired[0]}
    rates, prior = dict(start), 0.8
    clip = lambda x: min(0.9999, max(0.0001, x))
    for _ in range(200):
        p = []
        for doc in fired:
            g, b = prior, 1 - prior
            for r, hit in doc.items():
                g *= rates[r][0] if hit else 1 - rates[r][0]
                b *= rates[r][1] if hit else 1 - rates[r][1]
            p.append(g / (g + b))
        good, bad, old = sum(p), sum(1 - x for x in p), rates
        rates = {}
        for r in start:
            g = clip((20 * start[r][0] + sum(x for x, d in zip(p, fired) if d[r])) / (good + 20))
            b = clip((20 * start[r][1] + sum(1 - x for x, d in zip(p, fired) if d[r])) / (bad + 20))
            rates[r] = (max(g, b) if r in good_rules else min(g, b), b)
        prior = min(0.99, max(0.01, good / (good + bad)))
        if max(abs(x - y) for r in rates for x, y in zip(rates[r], old[r])) < 1e-9:
            break
    out = []
    for doc in fired:
        g, b = prior, 1 - prior
        for r, hit in doc.items():
            g *= rates[r][0] if hit else 1 - rates[r][0]
            b *= rates[r][1] if hit else 1 - rates[r][1]
        out.append(g / (g + b))
    return out


def test_the_verdict_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if words_of(r.text)}
    want = dict(zip(texts, slow_posteriors([slow_votes(t) for t in texts.values()])))
    rows = {r.doc_id: r for r in Q.judge(spark, docs).collect()}
    for doc_id, p in want.items():
        assert abs(rows[doc_id].quality - p) < 1e-6 and rows[doc_id].kept == (not rows[doc_id].base_failed and p >= 0.5)
    assert 0 < sum(r.kept for r in rows.values()) < len(rows)


def test_a_text_votes_alike_at_every_length(spark):
    words = [f"w{i % 45}a" for i in range(3000)]
    docs = spark.createDataFrame([(n, " ".join(words[:n])) for n in (450, 990, 999, 1000, 1001, 1999, 2000, 2990)], "doc_id long, text string")
    assert len({(r.vote_variety, r.vote_fresh) for r in Q.votes(Q.statistics(docs)).collect()}) == 1
