"""HTML extraction by template deduction over equivalence classes of tokens.

A token is a tag in its place: the path of element names and classes from the root. Over all pages of a
host each token has an occurrence vector, its count on every page. Vectors are compared through a
fingerprint that adds up over pages (a sum of 64-bit hashes of page and count), so tokens are grouped
with partial aggregation and a host with a third of all pages is many small partial sums, never one
group. Tokens with one vector form a class. A class is valid if its tokens stand on most pages of the
host and it nests: every token's parent is the root or in a valid class. Valid classes, nested, are the
host's template; what stands between template tokens are its slots.

A page's text goes to slots: the deepest template element above it. Slots under menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments are dropped, by element, role or class
name. The template chooses the main nodes of its host: its own article and main elements if they hold
text, else the lowest container that holds over half of the host's text. All that isn't dropped below a
main node is kept, but for blocks that repeat on most different pages of the host, which are template
text. Pages that their host's template doesn't fit (nothing kept) are read by their own elements alone.

Templates are a few dozen hashes a host; they reach pages by a join on host, which Spark broadcasts if it
is small and may split if it is skewed. Very long pages and deep nesting take time in proportion. Null and empty html give an empty text; null urls share one host.
Repeated rows count twice in the vectors and repeat their result. Empty tables give empty results. Other columns play
no part, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

MOST, PAGES = 0.5, 3  # text repeats if it stands on most of at least so many different pages
# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form script style noscript template title head iframe svg math canvas object embed audio video button select option textarea input label fieldset dialog menu textarea xmp".split())
# Words of class, id and role that mark what isn't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu navbar nav navigation breadcrumb breadcrumbs pagination pager header masthead footer comment comments disqus reply replies respond discussion share sharing social related recommended widget toolbar login search skip".split())
#: Of these, those that may also name parts of an article: within one they count only where a class has nothing else.
#: But for FILLER, words of lists and controls.
FILLER = frozenset("posts articles stories links list box bar button buttons items".split())
WEAK = frozenset("header masthead search related recommended discussion notice notices alert social skip banner widget overlay modal popup toolbar subscription promotion consent respond".split())
STEMS = ("comment", "advert", "sidebar", "cookie", "newsletter", "breadcrumb", "sponsor")
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar note status".split())
CLOSES = {  # Fixed values: what an opening tag ends, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
_SCOPE = frozenset("html body table td th caption button object article section div main aside nav header footer form fieldset blockquote li".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][-\w:.@]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("dropped", "inside", "name", "node", "token", "within")

    def __init__(self, name: str, token: int, dropped: bool, inside: int, node: int, within: bool):
        self.name, self.token, self.dropped, self.inside, self.node, self.within = name, token, dropped, inside, node, within


class Page:
    """What a page says: tokens with (count, parent token); its open elements as nodes (parent node, token), the
    root first and parents before children; text pieces as (node, dropped, node of the outermost article or main element above
    or 0, block, text); and the tokens of containers. Pieces of one block share its number."""

    def __init__(self) -> None:
        self.tokens: dict[int, tuple[int, int]] = {}
        self.nodes: list[tuple[int, int]] = [(0, 0)]
        self.pieces: list[tuple[int, bool, int, int, str]] = []
        self.containers: set[int] = set()

    def slots(self, template: set[int]) -> list[int]:
        """For each node its slot: the last node on the way down from the root whose way is all template."""
        out = [0]
        for i, (parent, token) in enumerate(self.nodes[1:], 1):
            out.append(i if out[parent] == parent and token in template else out[parent])
        return out


def _marked(name: str, attributes: dict[str, str], inside: int, within: bool) -> bool:
    """The element holds what isn't the article. inside: below an article or main element; within: below an article."""
    if name in DROPPED:
        # a header within an article holds its title, not the page's head
        return not (name == "header" and inside)
    if attributes.get("role", "").strip().lower() in ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if name in ("html", "body"):
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    if name in ("main", "article"):  # an article can be a reader's comment, and is seldom anything else
        return bool(inside) and ("comment" in named or "reply" in named)
    if any(x in named for x in STEMS):
        return True
    if not within:
        return bool(set(_PART.findall(named)) & MARKS)
    return any(parts & (MARKS - WEAK) or (parts & MARKS and parts <= (MARKS | FILLER) - {"header", "masthead"}) for x in named.split() if (parts := set(_PART.findall(x))))


def parsed(page: str | None) -> Page:
    """Read a page in one pass; time and memory are in proportion to its length, however deep it nests."""
    page = page or ""
    out = Page()
    tokens, nodes, pieces, containers = out.tokens, out.nodes, out.pieces, out.containers
    stack = [Element("", 0, False, 0, 0, False)]
    standing: dict[str, int] = {}
    block, at = 0, 0

    def add(text: str) -> None:
        if text:
            top = stack[-1]
            pieces.append((top.node, top.dropped, top.inside, block, text))

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """End the innermost of names and what it holds, unless one of until stands before it."""
        nonlocal block
        if not any(standing.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                if any(e.name in BLOCK for e in stack[i:]):
                    block += 1
                for e in stack[i:]:
                    standing[e.name] -= 1
                del stack[i:]
                return
            if stack[i].name in until:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group(1):
            name = m.group(1).lower()
            if name == "br":
                add(" ")
            elif name in BLOCK:
                close({name}, frozenset() if name in ("body", "html") else {"body", "html"})
                block += 1
            else:
                close({name}, BLOCK)
            continue
        name, rest = (m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5))
        if not name:
            continue
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        attributes = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest or "")}
        if name in _ENDS_P:
            close({"p"}, _SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        if name in BLOCK:
            block += 1
        label = re.sub(r"\d+", "0", f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}")
        parent = stack[-1].token
        token = xxhash.xxh64_intdigest(f"{parent}>{label}".encode("utf-8", "surrogatepass")) >> 1
        count, _ = tokens.get(token, (0, parent))
        tokens[token] = (count + 1, parent)
        if name in CONTAINERS:
            containers.add(token)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if (rest or "").rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        top = stack[-1]
        nodes.append((top.node, token))
        node = len(nodes) - 1
        inside = top.inside or (node if name in ("article", "main") or attributes.get("role") == "main" else 0)
        stack.append(Element(name, token, top.dropped or _marked(name, attributes, top.inside, top.within), inside, node, top.within or name == "article"))
        standing[name] = standing.get(name, 0) + 1
    return out


def joined(pieces: list[tuple]) -> str:
    """Blocks in page order: references decoded, white space as single spaces, trimmed."""
    blocks: dict[int, list[str]] = {}
    for *_, block, text in pieces:
        blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def block_keys(pieces: list[tuple]) -> dict[int, int]:
    """Block -> hash of its text, white space aside, for blocks with text."""
    blocks: dict[int, list[str]] = {}
    for *_, block, text in pieces:
        blocks.setdefault(block, []).append(text)
    words = ((block, " ".join("".join(x).split())) for block, x in blocks.items())
    return {block: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for block, x in words if x}


def main_text(page: str | None, template: set[int], main: set[int], repeated: set[int] | frozenset[int] = frozenset()) -> str:
    """Text below the main nodes without the host's repeated blocks; of the page's own elements if none is there."""
    read = parsed(page)
    good = [p for p in read.pieces if not p[1]]
    slot = read.slots(template)
    below = [0 in main]
    for i, (parent, token) in enumerate(read.nodes[1:], 1):
        below.append(below[parent] or (slot[i] == i and token in main))
    kept = [p for p in good if below[slot[p[0]]]]
    if kept and repeated:
        keys = block_keys(kept)
        kept = [p for p in kept if keys.get(p[3]) not in repeated]
    text = joined(kept)
    return text or joined([p for p in good if p[2]] or good)


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page_id, token, parent, count: what stands on each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            rows = []
            for page_id, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append((host, page_id, 0, 0, 1))  # the root stands on every page once
                rows += [(host, page_id, token, parent, count) for token, (count, parent) in parsed(page).tokens.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["host", "page_id", "token", "parent", "n"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "host", "html").mapInArrow(run, "host string, page_id long, token long, parent long, n int")


def classes(tokens: DataFrame) -> DataFrame:
    """host, token, parent, class (the fingerprint of its occurrence vector), pages."""
    vector = F.sum(F.xxhash64("page_id", "n").cast("decimal(20,0)"))  # exact, so it doesn't depend on order
    return tokens.groupBy("host", "token").agg(F.min("parent").alias("parent"), vector.alias("class"), F.count("*").alias("pages"))


def templates(spark: SparkSession, pages: DataFrame, most: float = MOST) -> DataFrame:
    """host, template: the tokens of its valid classes, nested under the root."""
    found = stored(spark, classes(page_tokens(pages)), "page-classes")
    hosts = found.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    sized = found.join(hosts, "host").where((F.col("token") != 0) & (F.col("pages") >= F.greatest(F.lit(most) * F.col("host_pages"), F.lit(1))))
    groups = sized.groupBy("host", "class").agg(F.collect_list(F.struct("token", "parent")).alias("members"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, templates = [], []
            for host, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_ = [{m["token"]: m["parent"] for m in g} for g in groups]
                valid, known = [], {0}
                while True:
                    # a class is valid once each of its tokens hangs on a valid one or on another of its own
                    fit = [g for g in open_ if all(p in known or p in g for p in g.values())]
                    if not fit:
                        break
                    valid += fit
                    known |= {t for g in fit for t in g}
                    open_ = [g for g in open_ if g not in fit]
                hosts.append(host)
                templates.append(sorted(known))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(templates, pa.list_(pa.int64()))], ["host", "template"])

    by_host = groups.groupBy("host").agg(F.collect_list("members").alias("classes"))
    return stored(spark, by_host.mapInArrow(nest, "host string, template array<long>"), "templates")


def _with_host(pages: DataFrame) -> DataFrame:
    """Adds the lower-case host of the URL; what has none shares the host ''."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\[\]]*)", 1))
    return pages.withColumn("host", F.regexp_replace(host, r"[\[\]]", ""))


def _main_nodes(nodes: list[dict]) -> list[int]:
    """The template's articles if they hold text; else the lowest container with over half of the host's text."""
    if articles := [n["slot"] for n in nodes if n["article"]]:
        return articles
    now, total = 0, max((n["chars"] for n in nodes if n["slot"] == 0), default=0)
    while below := [n["slot"] for n in nodes if n["slot"] and n["parent"] == now and 2 * n["chars"] > total]:
        now = below[0]
    return [now]


def slots(spark: SparkSession, pages: DataFrame, known: DataFrame) -> DataFrame:
    """host, template, main (its main nodes), repeated (hashes of the blocks on most of the host's different pages)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            held: dict[tuple[str, int, int, bool], int] = {}
            rows = []
            for host, page, template in zip(*(batch.column(i).to_pylist() for i in range(3))):
                known, read = set(template or ()), parsed(page)
                nodes, slot = read.nodes, read.slots(known)
                good = [p for p in read.pieces if not p[1]]
                # each node's own or next container within the template; texts add up from there to the root
                home = [0]
                for i, (parent, token) in enumerate(nodes[1:], 1):
                    home.append(i if slot[i] == i and token in read.containers else home[parent])
                chars = [0] * len(nodes)
                articles: dict[int, int] = {}
                for node, _, article, _, text in good:
                    if n := len(text.strip()):
                        chars[home[slot[node]]] += n
                        if article and slot[article] == article:
                            articles[article] = articles.get(article, 0) + n
                for i in range(len(nodes) - 1, -1, -1):
                    if chars[i]:
                        above = home[nodes[i][0]]
                        if i:
                            chars[above] += chars[i]
                        key = (host, nodes[i][1], nodes[above][1], False)
                        held[key] = held.get(key, 0) + chars[i]
                for node, n in articles.items():
                    key = (host, nodes[node][1], 0, True)
                    held[key] = held.get(key, 0) + n
                same = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1
                rows += [(host, None, None, None, None, key, same) for key in {0, *block_keys(good).values()}]
            rows += [(*k, n, None, None) for k, n in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["host", "slot", "parent", "article", "chars", "text", "page"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_main_nodes(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["host", "main"])

    given = pages.join(known, "host", "left").select("host", "html", "template")
    found = stored(spark, given.mapInArrow(read, "host string, slot long, parent long, article boolean, chars long, text long, page long"), "page-slots")
    sums = found.where("slot IS NOT NULL").groupBy("host", "slot", "parent", "article").agg(F.sum("chars").alias("chars"))
    main = sums.groupBy("host").agg(F.collect_list(F.struct("slot", "parent", "article", "chars")).alias("all")).mapInArrow(choose, "host string, main array<long>")
    texts = found.where("text IS NOT NULL").groupBy("host", "text").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= F.lit(MOST * PAGES))
    hosts = found.where("text = 0").groupBy("host").agg(F.count_distinct("page").alias("host_pages")).where(F.col("host_pages") >= PAGES)
    often = texts.where("text <> 0").join(hosts, "host").where(F.col("n") > MOST * F.col("host_pages")).groupBy("host").agg(F.collect_list("text").alias("repeated"))
    return stored(spark, main.join(known, "host", "left").join(often, "host", "left").select("host", "template", "main", "repeated"), "slots")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kind = dict(pages.dtypes)["page_id"]
    hosted = _with_host(pages.select("page_id", "url", "html"))
    found = slots(spark, hosted, templates(spark, hosted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, set(template or ()), set(main or ()), set(repeated or ())) for page, template, main, repeated in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    given = hosted.join(found, "host", "left").select("page_id", "url", "html", "template", "main", "repeated")
    return given.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
