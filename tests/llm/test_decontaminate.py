import random

import numpy as np

from corpusmill.llm import decontaminate as C

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a strange purple potion near the old stone bridge at midnight."


def edits(pattern, text):
    """Least edits of the pattern anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def spoiled(text, n, rng):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        how = rng.randrange(3)
        if how == 0:
            chars[i] = "q"
        elif how == 1:
            del chars[i]
        else:
            chars.insert(i, "z")
    return "".join(chars)


def test_finds_what_brute_force_finds():
    rng = random.Random(2)
    block = C.Block([(1, ITEM)])
    segments = [s[0] for s in block.segments]
    letters = "abcdefghij     "
    for trial in range(60):
        around = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(2)]
        text = around[0] + spoiled(ITEM, rng.randrange(0, 30), rng) + around[1]
        codes, _ = C.normal(text)
        plain = "".join(map(chr, codes))
        want = any(edits("".join(map(chr, s)), plain) <= k for (s, k, _, _) in block.segments)
        assert bool(block.search([text])[0]) == want, trial
    assert segments


def test_banded_alignment():
    rng = random.Random(4)
    pairs = []
    for _ in range(40):
        pattern = "".join(rng.choice("abcd") for _ in range(30))
        pairs.append((pattern, spoiled(pattern, rng.randrange(5), rng)))
    to = lambda x, n: [ord(c) for c in x] + [C.NOTHING] * (n - len(x))
    regions = np.array([[C.NOTHING] * 30 + to(t, 79) for _, t in pairs], np.uint32)
    got, _ = C.banded_edits(np.array([to(p, 30) for p, _ in pairs], np.uint32), regions)
    assert got.tolist() == [edits(p, t) for p, t in pairs]


def test_grams_of_any_length():
    codes = np.array([ord(c) for c in "the cat sat on the mat"], np.uint32)
    for q in range(1, 13):
        values = C.grams(codes, q)
        plain = ["the cat sat on the mat"[i : i + q] for i in range(22 - q + 1)]
        assert len(values) == len(plain) and len(set(values.tolist())) == len(set(plain))


def test_repetitive_text_is_no_candidate():
    block = C.Block([(1, ITEM)])
    assert block.candidates(C.normal("the lazy the lazy " * 200)[0]) == []


def test_regions_and_case_and_space(spark):
    text = "Some words first. " + ITEM.upper().replace(" ", "  \n") + " And some after."
    docs = spark.createDataFrame([(1, text), (2, "Nothing of the kind here, just plain text that goes on for a while without any match at all."), (3, ITEM[:100])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM), (10, "short"), (11, None)], "item_id long, text string")
    rows = C.contamination(spark, docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 9), (3, 9)]
    hit = next(r for r in rows if r.doc_id == 1)
    assert hit.edits == 0 and " ".join(text[hit.start : hit.end].split()).lower() == ITEM.lower()
    assert [r.doc_id for r in C.clean(spark, docs, bench).collect()] == [2]


def test_blocks_split_nothing(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    small = [items.value for _, items in C.blocks(spark, bench, 3_000)]
    whole = [items.value for _, items in C.blocks(spark, bench)]
    assert len(small) > 1 and len(whole) == 1
    assert sorted(x for b in small for x in b) == sorted(whole[0])
    assert all(sum(len(t) for _, t in b) <= 3_000 or len(b) == 1 for b in small)


def test_whole_items_in_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    squash = lambda x: " ".join(x.lower().split())
    items = [(r.item_id, squash(r.text)) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in squash(d.text)}
    got = {(r.doc_id, r.item_id) for r in C.contamination(spark, docs, bench).collect()}
    assert want <= got


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert C.contamination(spark, odd, bench).count() == 0
    assert C.clean(spark, odd, bench).count() == 10
    assert C.clean(spark, empty, bench).count() == 0
    assert C.contamination(spark, odd, bench.where("false")).count() == 0


def test_passages_of_95_characters():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghijklmnop ") for _ in range(600)).replace("  ", " x")
    block = C.Block([(1, item)])
    for start in range(0, len(item) - 95, 7):
        assert block.search([f"zz {item[start : start + 95]} zz"])[0], start


def test_short_items():
    block = C.Block([(1, "Short answer is 42!"), (2, "yes"), (3, "exactly"), (4, "  \n"), (5, "short answer is 42!")])
    find = lambda t: sorted((i, t[a:b]) for i, a, b, _ in block.search([t])[0])
    assert find("The SHORT  answer\nis 42! Right") == [(1, "SHORT  answer\nis 42!"), (5, "SHORT  answer\nis 42!")]
    assert find("ashort answer is 42!") == [] == find("short answer is 43!")
    assert find(" Yes\n") == [(2, "Yes")] and find("yes indeed") == [] and find("exactly") == [(3, "exactly")] and find("") == [] and find(None) == []


def test_a_prompt_that_items_share():
    """Items of one repeated phrase: memory follows the text and pieces, not items times places, and each item is found."""
    import tracemalloc

    block = C.Block([(i, "Question: what is it? Answer: " * 6 + str(i)) for i in range(1_500)])
    text = "question: what is it? answer: " * 40
    tracemalloc.start()
    hits = block.search([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len({i for i, *_ in hits}) == 1_500 and peak < 300e6


def slow_hits(text, items):
    """Items with a segment (or, short, the whole) within its budget anywhere in the text."""
    plain, found = " ".join(text.lower().split()), set()
    for item_id, item in items:
        item = " ".join(item.lower().split())
        if not item:
            continue
        m = min(80, len(item))
        for s in {*range(0, len(item) - m + 1, 16), len(item) - m}:
            if edits(item[s : s + m], plain) <= (8 if m == 80 else int(0.1 * m) if m + 1 - 8 - int(0.1 * m) * 8 >= 1 else 0):
                found.add(item_id)
    return found


def test_the_table_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(20)]
        if i % 2:
            item = rng.choice(items)[1]
            a = rng.randrange(max(1, len(item) - 60))
            text.insert(10, spoiled(item[a : a + rng.randrange(40, 200)], rng.randrange(12), rng))
        rows.append((i, " ".join(text)))
    hits = C.contamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(i, x) for i, t in rows for x in slow_hits(t, items)}
