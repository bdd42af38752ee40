import random

from corpusmill.llm import html_extract as H


def extracted(spark, htmls):
    rows = [(i, f"https://h.example/{i}", x) for i, x in enumerate(htmls)]
    return [r.text for r in sorted(H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(999)}" for _ in range(n))


def test_blocks_that_repeat_inside_the_article_are_template(spark):
    rng = random.Random(1)
    texts = [prose(rng, 40) for _ in range(20)]
    pages = [f"<body><article><h1>T{i}</h1><div class='box'><p>Join <b>our</b> list</p></div><p>{t}</p></article><div>x{i}</div></body>" for i, t in enumerate(texts)]
    assert extracted(spark, pages) == [f"T{i}\n{t}" for i, t in enumerate(texts)]


def test_copies_of_one_page_are_not_template(spark):
    assert extracted(spark, ["<article><p>same text</p></article>"] * 6) == ["same text"] * 6


def test_an_article_off_the_template_does_not_choose_for_its_page(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) for _ in range(20)]
    pages = [f"<body><div class='story'><p>{t}</p></div>" + ("<div><article>teaser</article></div>" if i == 3 else "") + "</body>" for i, t in enumerate(texts)]
    assert extracted(spark, pages) == texts


def test_short_slots_beside_the_main_text_stay(spark):
    rng = random.Random(3)
    parts = [(f"Title {i}", prose(rng, 3), prose(rng, 200), f"said {i}", f"item {i}") for i in range(20)]
    pages = [f"<body><div class='top'><p>{prose(rng, 2)}</p></div><div class='story'><h1>{a}</h1><h2>{b}</h2><p>{c}</p><blockquote>{d}</blockquote><ul><li>{e}</li></ul></div></body>" for a, b, c, d, e in parts]
    assert extracted(spark, pages) == ["\n".join(x) for x in parts]


def test_classes_that_name_parts_of_the_article_stay(spark):
    pages = [
        f"<body><div class='search'>find</div><article><div class='article-header'><h1>Title {i}</h1></div><p>body {i}</p><div class='search-results'><p>found {i}</p></div>"
        f"<section class='related-work'><p>work {i}</p></section><div class='related'>teaser</div><div class='share-bar'>like</div><div class='newsletter-signup'>join</div></article></body>"
        for i in range(6)
    ]
    assert extracted(spark, pages) == [f"Title {i}\nbody {i}\nfound {i}\nwork {i}" for i in range(6)]


def test_time_is_linear_in_nesting():
    import time

    def seconds(n):
        page = "<div>x" * n + "</p>" * n + "<b>y" * n + "</div>" * n
        began = time.process_time()
        H.main_text(page, set(), set())
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)


def test_the_template_decides_where_no_element_is_named(spark, sf):
    """The fixture with article renamed: the text comes from the host's template and is the same."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(400)
    one_host = pages.withColumn("url", __import__("pyspark").sql.functions.lit("https://one.example/x"))
    bare = one_host.selectExpr("page_id", "url", "replace(replace(html, '<article', '<div class=\"x9\"'), '</article>', '</div>') AS html")
    want = {r.page_id: r.text for r in H.extract(spark, one_host).collect()}
    got = {r.page_id: r.text for r in H.extract(spark, bare).collect()}
    assert sum(got[i] == want[i] for i in want) > 0.9 * len(want)
    assert not any("article" in r.html for r in bare.limit(50).collect())


def slow_extraction(pages):
    """The deduction from its definition, for well-formed pages of plain elements: vectors as tuples, no hashes, no arrays."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.seen, self.texts = [], [()], []

        def handle_starttag(self, tag, attrs):
            self.stack.append((tag, dict(attrs).get("class", "")))
            self.seen.append(tuple(self.stack))

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            if data.strip():
                self.texts.append((tuple(self.stack), " ".join(data.split())))

    read = []
    for page in pages:
        reader = Reader()
        reader.feed(page)
        read.append(reader)
    tokens = {t for r in read for t in r.seen}
    vector = {t: tuple(r.seen.count(t) for r in read) for t in tokens}
    valid = {()}
    groups = {}
    for t in tokens - {()}:
        if sum(n > 0 for n in vector[t]) >= max(1, len(read) / 2):
            groups.setdefault(vector[t], set()).add(t)
    while fit := [v for v, g in groups.items() if all(t[:-1] in valid or t[:-1] in g for t in g)]:
        for v in fit:
            valid |= groups.pop(v)

    def slot(path):
        n = 0
        while n < len(path) and path[: n + 1] in valid:
            n += 1
        return path[:n]

    mass = {}
    for r in read:
        for path, text in r.texts:
            for n in range(len(slot(path)) + 1):
                if n == 0 or path[n - 1][0] in H.CONTAINERS:
                    mass[path[:n]] = mass.get(path[:n], 0) + len(text)
    main = ()
    while True:
        below = [p for p in mass if len(p) > len(main) and p[: len(main)] == main and 2 * mass[p] > mass[()]]
        nearest = [p for p in below if not any(q != p and p[: len(q)] == q for q in below)]
        if not nearest:
            break
        main = nearest[0]
    often = {t for r in read for _, t in r.texts if sum(t in {x for _, x in q.texts} for q in read) > len(read) / 2}
    return ["\n".join(t for path, t in r.texts if slot(path)[: len(main)] == main and t not in often) for r in read]


def test_against_the_definition(spark):
    rng = random.Random(9)
    for trial in range(3):
        pages = []
        for i in range(24):
            story = "".join(f"<p>{prose(rng, rng.randrange(5, 40))}</p>" for _ in range(rng.randrange(1, 5)))
            extra = f"<div class='more{trial}'><p>{prose(rng, 4)}</p></div>" if rng.random() < 0.4 else ""
            pages.append(
                f"<html><body><div class='top'><p>{prose(rng, 3)}</p><p>Our motto</p></div><div class='mid'><section class='text'><h1>{prose(rng, 4)}</h1>{story}<p>Read on</p></section>{extra}</div>"
                f"<div class='low'><p>{prose(rng, 2)}</p></div></body></html>"
            )
        assert extracted(spark, pages) == slow_extraction(pages), trial
