import random

from corpusmill.llm import html_extract as H


def text(page):
    return H.main_text(page, set(), set())


def test_article_without_what_is_around_it():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <article><h1>A &amp; B</h1><p><b>First.<br>line</p><p>Second&nbsp;one <a href=x>link</a>
      here.<aside>aside</aside><form><label>n</label></form><div class="ad">Buy</div><ul><li>one<li>two</ul>
    <section id="comments"><p>Nice post</p></section></article><footer>&copy; me</footer></body>"""
    assert text(page) == "A & B\nFirst. line\nSecond one link here.\none\ntwo"


def test_comments_notices_and_hidden_parts():
    page = """<body class="has-sidebar"><main><div id=top-notice>n</div><article><p>x<p style="display: none">no</p><p>y</p></article>
    <ol class="commentList"><li>c1</ol><article class="userComment"><p>c2</p></article><div role="status">s</div><section class=related-posts>r</section></main></body>"""
    assert text(page) == "x\ny"


def test_blocks_unclosed_and_cut():
    assert text("<body><article><p><b>T.<br><p>x &lt;b&gt; y<p>cut &amp") == "T.\nx <b> y\ncut &"
    assert text("<article>a<p>b</p>c</article>") == "a\nb\nc"
    assert text("plain & simple") == "plain & simple"
    assert text("<p>a < b and 1<2</p>") == "a < b and 1<2"
    assert text("<article><p title='a>b'>q</p><script>if (a<b) {}</script ><p>r</p></article>") == "q\nr"
    assert text("<article><header><h1>Title</h1></header><p>x</p></article>") == "Title\nx"
    assert text("<article><p>&amp;lt; once</p></article>") == "&lt; once"
    assert text(None) == text("") == text("<script>only") == ""


def test_templates_find_the_slot_without_semantic_elements(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows = [(i, f"https://Host.example:80/{i}", f"<html><body><div class='top'><p>{words(3)}</p></div><div class='story'>{''.join(f'<p>{words(40)}</p>' for _ in range(rng.randrange(1, 5)))}</div><div class='end'>x {i}</div></body></html>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = H.templates(spark, H._with_host(pages)).collect()
    assert len(found) == 1 and found[0].host == "host.example" and len(found[0].template) >= 6
    for r in H.extract(spark, pages).collect():
        page = rows[r.page_id][2]
        story = page.split("<div class='story'>")[1].split("</div>")[0]
        assert r.text == "\n".join(p.split("</p>")[0] for p in story.split("<p>")[1:]) and r.n_chars == len(r.text)


def test_invalid_classes_stay_out_of_the_template(spark):
    rows = [(i, "http://h/", "<body><article><p>x</p></article>" + ("<table><tr><td>rare</td></tr></table>" if i == 0 else "") + "</body>") for i in range(10)]
    pages = H._with_host(spark.createDataFrame(rows, "page_id long, url string, html string"))
    template = set(H.templates(spark, pages).collect()[0].template)
    tokens = H.parsed(rows[0][2]).tokens
    assert len(template - {0}) == 3 and len(set(tokens) - template) == 3


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = H.extract(spark, pages).collect()
    assert sorted(r.page_id for r in rows) == sorted(html)
    import html as entities
    import re

    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", html[r.page_id], re.S)
        pieces = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article.group(1))]
        assert r.text == "\n".join(x for x in pieces if x)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://a/", "<p>x</p>"), (3, "http://[bad", "<p>y</p>"), (3, "http://[bad", "<p>y</p>"), (4, "http://a/", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS host")
    got = sorted((r.page_id or 0, r.n_chars) for r in H.extract(spark, pages).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 249_999)]
    assert H.extract(spark, pages.where("false")).count() == 0
