"""Column expressions over text: all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token when no tokenizer is at hand: a word, or one other visible character.
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\s]"
#: Lower edges of the five length bands; the last edge is folded into the last band.
BAND_EDGES = (16, 64, 256, 1024, 2048, 4096)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def newline_normalised(text: Column | str) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column | str) -> Column:
    """Without white space at either end, any Unicode white space."""
    return F.btrim(col(text), F.lit(WHITE))


def content_hash(text: Column | str) -> Column:
    """MD5 hex of the stripped text."""
    return F.md5(stripped(text))


def token_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(TOKEN)).cast("long")


def contains_any(text: Column | str, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(text), F.lit(m)) for m in markers])


def generated_marker(text: Column | str, markers: tuple[str, ...], head: int = 400) -> Column:
    """Any marker in the first characters, case ignored."""
    return contains_any(F.lower(F.left(col(text), F.lit(head))), markers)


def band(n_tokens: Column | str, edges: tuple[int, ...] = BAND_EDGES) -> Column:
    """0-based length band; null outside of all. The last edge itself is in the last band."""
    n, out = col(n_tokens), F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low, high = edges[i], edges[i + 1] + (i == len(edges) - 2)
        out = F.when((n >= low) & (n < high), F.lit(i)).otherwise(out)
    return out


def size_bucket(n_tokens: Column | str) -> Column:
    n = col(n_tokens)
    return F.when(n < 32, "tiny").when(n < 64, "small").when(n < 256, "mid").when(n < 1024, "large").otherwise("XL")


def line_shape(text: Column | str) -> dict[str, Column]:
    """Lines, longest line, white space (space, tab, LF, CR) and whether 201 ASCII letters or digits stand together."""
    lines = F.split(col(text), "\n")
    return {
        "n_lines": F.size(lines).cast("long"),
        "max_line": F.array_max(F.transform(lines, lambda x: F.length(x))).cast("long"),
        "n_space": F.regexp_count(col(text), F.lit(r"[ \t\n\r]")).cast("long"),
        "alnum_run": col(text).rlike(r"[0-9A-Za-z]{201}"),
    }


def junk_rules(n_chars: Column, n_lines: Column, max_line: Column, n_space: Column, alnum_run: Column, n_tokens: Column, string_share: Column, hard: int = 1000, mean: int = 200, space: float = 0.05, strings: float = 0.9, long: int = 512) -> dict[str, Column]:
    """The hard rule and four soft ones; junk is hard, or two soft."""
    out = {
        "hard_line": max_line > hard,
        "soft_mean": n_chars > mean * n_lines,
        "soft_ws": n_space < space * n_chars,
        "soft_run": alnum_run,
        "soft_str": (string_share > strings) & (n_tokens >= long),
    }
    soft = reduce(lambda a, b: a + b, [v.cast("int") for k, v in out.items() if k != "hard_line"])
    return out | {"junk": out["hard_line"] | (soft >= 2)}


def row_id(pile: Column | str, shard: Column | str, line: Column | str) -> Column:
    return F.format_string("p%d:s%d:l%d", col(pile), col(shard), col(line))


def parse_row_id(row_id_: Column | str) -> dict[str, Column]:
    return {n: F.regexp_extract(col(row_id_), r"^p(\d+):s(\d+):l(\d+)$", i).cast("long") for i, n in enumerate(("pile", "shard", "line"), 1)}


def short_name(qualified: Column | str) -> Column:
    return F.element_at(F.split(col(qualified), "[.]"), -1)


def seed_of(text: Column | str) -> Column:
    """First 12 hex digits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(col(text)), 1, 12), 16, 10).cast("long")


def hash_order(seed: str, *keys: str) -> Column:
    """Deterministic shuffle key: the substitute for a seeded set-level draw."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def uniform(seed: str, *keys: str) -> Column:
    """Hash to [0, 1): 48 bits of hash_order."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def clamp_timestamp(ts: Column | str, now: int) -> Column:
    """Epoch seconds; a time in the future becomes -1 (no time)."""
    return F.when(col(ts) > now, F.lit(-1)).otherwise(F.coalesce(col(ts), F.lit(-1))).cast("long")


# --- prose and exemplars ---------------------------------------------------------------------------

TRIPLE = r'(?s)"""(.*?)"""|' + r"'''(.*?)'''"
EXEMPLARS = {  # Fixed values: what an exemplar span can be
    "url": r"https?://[^\s\"'<>]+",
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "version": r"\b\d+\.\d+\.\d+\b",
    "hex": r"\b0x[0-9a-fA-F]+\b",
    "number": r"\b\d{5,}\b",
}


def exemplar_counts(text: Column | str) -> dict[str, Column]:
    return {k: F.regexp_count(col(text), F.lit(v)).cast("long") for k, v in EXEMPLARS.items()}


def prose_stripped(text: Column | str) -> Column:
    """Triple-quoted strings emptied, comments cut, blanks squeezed, blank lines collapsed, line ends trimmed."""
    x = F.regexp_replace(col(text), TRIPLE, '""')
    x = F.regexp_replace(x, r"#[^\n]*", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" +\n", "\n")
    return F.regexp_replace(x, r"\n{2,}", "\n")


def regex_docstring(text: Column | str, least: int = 8) -> Column:
    """The first triple-quoted string, white space collapsed; null if shorter than `least`."""
    inner = F.coalesce(F.nullif(F.regexp_extract(col(text), TRIPLE, 1), F.lit("")), F.regexp_extract(col(text), TRIPLE, 2))
    flat = F.trim(F.regexp_replace(inner, r"\s+", " "))
    return F.when(F.length(flat) >= least, flat)


# Fixed values in the next two: marks of docstring conventions, exception headings and names.


def docstring_style(doc: Column | str) -> Column:
    """One convention found: that; none: plain prose; several: null."""
    found = {
        "NumPy style": col(doc).rlike(r"\n\s*(Parameters|Returns|Raises)\s*\n\s*-{3,}"),
        "Google style": col(doc).rlike(r"\n\s*(Args|Arguments|Returns|Raises|Yields)\s*:\s*\n"),
        "Sphinx/reST style": col(doc).rlike(r":(param|returns?|rtype|raises)\b"),
    }
    hits = reduce(lambda a, b: a + b, [x.cast("int") for x in found.values()])
    named = F.coalesce(*[F.when(x, F.lit(k)) for k, x in found.items()])
    return F.when(hits == 0, "plain prose").when(hits == 1, named)


def documented_raises(doc: Column | str) -> Column:
    """Exception names after the first Raises heading, distinct and sorted; null without one."""
    section = F.regexp_extract(col(doc), r"(?is)(?:^|\n)\s*(?:Raises?\s*[:\n]|:raises?\s+).*", 0)
    names = F.regexp_extract_all(section, F.lit(r"\b([A-Z][A-Za-z]*(?:Error|Exception|Warning|Interrupt|Exit|Iteration))\b"), F.lit(1))
    return F.when(section != "", F.array_sort(F.array_distinct(names)))


def def_name(code: Column | str, index: Column | str) -> Column:
    """The first function's name, else fn and the index."""
    found = F.nullif(F.regexp_extract(col(code), r"(?:async )?def (\w+)", 1), F.lit(""))
    return F.coalesce(found, F.concat(F.lit("fn"), col(index).cast("string")))


def padded_width(n: Column | str, buckets: tuple[int, ...] = (), step: int = 16) -> Column:
    """The least bucket that holds n; above all buckets the next multiple of step."""
    up = (F.ceil(col(n) / step) * step).cast("long")
    if not buckets:
        return up
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(b) for b in buckets]), lambda b: b >= col(n))).cast("long"), up)


def slot_count(n_tokens: Column | str, pf: int) -> Column:
    return (F.ceil(col(n_tokens) / pf) + 2).cast("long")


def half(n: Column | str, least: int = 16) -> Column:
    return F.greatest(F.floor(col(n) / 2), F.lit(least)).cast("long")


# --- questions, answers and grades -------------------------------------------------------------------

# What a generated question must not speak of, the prefixes it may begin with, and answers too common to leak.
META = r"(?i)fact card|ground.truth|style directive|as an ai|i cannot|the answer is"
PREFIXES = ("Question:", "question:", "Q:")
TRIVIAL = ("none", "then", "else", "true", "false")


def text_norm(text: Column | str) -> Column:
    """Quotes of all kinds to \", lower case, white space as single spaces, trimmed."""
    x = F.translate(col(text), "‘’“”'", '"' * 5)
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def question_repair(text: Column | str, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Think blocks, outer backticks, known prefixes (each once, in order), matching outer quotes and extra white space go."""
    x = stripped(F.regexp_replace(col(text), r"(?s)<think>.*?</think>", ""))
    x = stripped(F.regexp_replace(x, r"^`+|`+$", ""))
    for p in prefixes:
        x = F.when(F.startswith(x, F.lit(p)), stripped(F.substring(x, len(p) + 1, 1 << 30))).otherwise(x)
    outer = (F.length(x) >= 2) & (F.left(x, F.lit(1)) == F.right(x, F.lit(1))) & F.left(x, F.lit(1)).isin('"', "'")
    x = F.when(outer, x.substr(F.lit(2), F.length(x) - 2)).otherwise(x)
    return stripped(F.regexp_replace(x, r"\s+", " "))


def format_reject(text: Column | str) -> Column:
    """First reason to reject a question, or null."""
    t = col(text)
    return (
        F.when(F.coalesce(F.length(t), F.lit(0)) == 0, "empty").when(F.length(t) < 8, "too_short").when(F.length(t) > 500, "too_long")
        .when(~t.rlike("[A-Za-z]"), "no_letters").when(F.contains(t, F.lit("```")), "code_fence").when(t.rlike(META), "meta_reference")
    )


def quoted(term: Column) -> Column:
    """A term as a literal inside a Java regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def bounded_in(text: Column, term: Column) -> Column:
    """The term stands in the text with no word character (of any script) at either side."""
    return F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted(term), F.lit(r"(?!\w)")))


def leak_terms(answer: Column, answer_type: Column, extra: Column) -> Column:
    """What a question must not contain: the extra terms, the answer unless it says nothing, and each of several names."""
    nothing = F.array().cast("array<string>")
    own = F.when(answer_type.isin("yesno", "letter") | text_norm(answer).isin(*TRIVIAL), nothing).when((answer_type == "name") & F.contains(answer, F.lit(",")), F.concat(F.array(answer), F.split(answer, ","))).otherwise(F.array(answer))
    plain = F.transform(F.concat(extra, own), lambda x: F.trim(F.btrim(text_norm(x), F.lit('"'))))
    return F.filter(plain, lambda x: x.isNotNull() & (x != ""))


def leaks(question: Column, terms: Column) -> Column:
    """Any term (of leak_terms) shows: a number not inside a word or decimal, a word on its bounds, other terms of three characters anywhere, short symbols on word bounds."""
    q = text_norm(question)
    number = lambda t: F.regexp_like(q, F.concat(F.lit(r"(?U)(?<![\w.])"), quoted(t), F.lit(r"(?![\w.])")))
    shows = lambda t: (
        F.when(t.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), number(t)).when(t.rlike(r"(?U)^\w+$"), bounded_in(q, t))
        .when(F.length(t) >= 3, F.contains(q, t)).otherwise(~t.rlike(r"(?U)\w") & bounded_in(q, t))
    )
    return F.exists(terms, shows)


def first_line(pred: Column | str, most: int = 200) -> Column:
    return F.left(stripped(F.split_part(col(pred), F.lit("\n"), F.lit(1))), F.lit(most))


def corrected(pred: Column | str, most: int = 200) -> Column:
    """Cut at the first line end, Q: or A:."""
    x, far = col(pred), 1 << 30
    at = [F.when(F.locate(m, x) > 0, F.locate(m, x)).otherwise(F.lit(far)) for m in ("\n", "Q:", "A:")]
    return F.left(stripped(F.substring(x, F.lit(1), F.least(*at) - 1)), F.lit(most))


def graded(pred: Column, gold: Column, kind: Column, intent: Column, siblings: Column) -> Column:
    """Whether a prediction answers the gold by its type; false for null."""
    p = stripped(F.regexp_replace(pred, r"(?s)<think>.*?</think>", ""))
    norm_p, norm_g = text_norm(p), text_norm(gold)
    digits = lambda x: F.regexp_extract_all(x, F.lit(r"([0-9]+)"), F.lit(1))
    names = lambda x: F.filter(F.transform(F.split(x, ","), lambda n: text_norm(n)), lambda n: n != "")
    number = F.nullif(F.regexp_extract(p, r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")
    want, others = names(gold), F.filter(F.transform(siblings, lambda n: text_norm(n)), lambda n: n != "")
    seen = F.filter(F.array_distinct(F.concat(want, others)), lambda n: bounded_in(norm_p, n))
    as_set = (F.size(F.array_distinct(want)) == F.size(want)) & (F.array_sort(seen) == F.array_sort(want))
    alone = bounded_in(norm_p, norm_g) & ~F.exists(others, lambda n: (n != norm_g) & bounded_in(norm_p, n))
    several = (kind == "name") & F.contains(gold, F.lit(","))
    return F.coalesce(
        F.when(kind == "yesno", F.regexp_extract(F.lower(p), r"\b(yes|no)\b", 1) == gold).when(kind == "letter", F.regexp_extract(p, r"\b([A-D])\b", 1) == gold)
        .when(kind == "number", number == gold.try_cast("double")).when(kind == "line_ref", digits(p) == digits(gold)).when(norm_g == "", F.lit(False))
        .when(several & (intent == "I6"), as_set).when(several, names(norm_p) == want).when(kind == "name", alone).otherwise(F.contains(norm_p, norm_g)),
        F.lit(False),
    )


def byte_exact(reference: Column | str, generation: Column | str) -> Column:
    """The generation begins with the reference and goes on, if at all, at a clean boundary."""
    r, g = col(reference), col(generation)
    rest = F.substring(g, F.length(r) + 1, F.lit(1 << 30))
    return F.startswith(g, r) & ((rest == "") | F.startswith(rest, F.lit("\n")) | F.endswith(r, F.lit("\n")))


def ordinal(n: Column | str) -> Column:
    tail, two = col(n) % 10, col(n) % 100
    suffix = F.when(two.between(10, 20), "th").when(tail == 1, "st").when(tail == 2, "nd").when(tail == 3, "rd").otherwise("th")
    return F.concat(col(n).cast("string"), suffix)


def options_prompt(question: Column, options: Column) -> Column:
    """The question with lettered options and where the answer goes."""
    lines = F.transform(options, lambda o, i: F.concat(F.chr(i + 65), F.lit(") "), o))
    return F.concat(F.lit("Q: "), question, F.when(F.size(options) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"))).otherwise(F.lit("")), F.lit("\nA:"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity_floor(n_tokens: Column | str) -> Column:
    n = col(n_tokens)
    return F.when(n < 8, 0.90).when(n < 20, 0.75).otherwise(0.65)


def rouge_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def mod_of_md5(text: Column | str, n: int) -> Column:
    """MD5 as a 128-bit number modulo n, from its four 32-bit parts."""
    out = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(F.md5(col(text)), 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * ((1 << 32) % n) + part) % n
    return out


def judge_passes(pair_id: Column | str, most: int = 95) -> Column:
    """The deterministic stand-in for a judge."""
    return mod_of_md5(F.concat(F.lit("judge|"), col(pair_id)), 100) < most


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a rate."""
    p, n = k / n, n.cast("double")
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def skeleton(text: Column | str, keywords: tuple[str, ...]) -> Column:
    """Words to N, digits to 0, keywords and marks as they stand, white space gone; the hash input of a family."""
    runs = F.regexp_extract_all(col(text), F.lit(r"([0-9A-Za-z_]+|[^0-9A-Za-z_\s])"), F.lit(1))
    kept = F.transform(runs, lambda x: F.when(x.isin(*keywords), x).when(x.rlike("^[0-9]"), F.lit("0")).when(x.rlike("^[A-Za-z_]"), F.lit("N")).otherwise(x))
    return F.array_join(kept, " ")


def token_accuracy(truth: Column, guess: Column) -> Column:
    """Share of positions that agree, of the truth's length."""
    same = F.aggregate(F.zip_with(truth, guess, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    return F.when(F.size(truth) > 0, same / F.size(truth)).otherwise(F.lit(0.0))
