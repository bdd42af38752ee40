"""Corpus-build queries over documents (rows), lang (piles), source (repos), and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import corpus as O
from corpusmill.operators import draw, similar
from corpusmill.sources.storage import stored

from .registry import query, table

#: Fixed values used by the queries here; the published ones where the driver's tables are large enough for them to bind.
MARKERS = ("auto-generated", "generated by", "do not edit", "license", "version")
PII_MARKERS = ("<NAME>", "@mail", "password=", "AKIA")
REPO_CAP, FAMILY_REPOS, BAND_QUOTA = 30, 3, 60
KEYWORDS = ("the", "and", "of", "to", "in", "de", "la", "der", "und", "le")

BASE = r"""base AS (SELECT doc_id, text, lang, source, n_chars,
  CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS pile,
  len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]'))::BIGINT AS ntok,
  md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS h FROM documents)"""
BAND = "CASE WHEN ntok < 16 THEN NULL WHEN ntok < 64 THEN 0 WHEN ntok < 256 THEN 1 WHEN ntok < 1024 THEN 2 WHEN ntok < 2048 THEN 3 WHEN ntok <= 4096 THEN 4 END"


def base(spark: SparkSession, sf: str) -> DataFrame:
    pile = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    return table(spark, sf, "documents").withColumn("pile", pile).withColumn("ntok", C.token_count("text")).withColumn("h", C.content_hash("text"))


def slim(spark: SparkSession, sf: str) -> DataFrame:
    """The annotation table, without the text: what dedup, caps and draws carry through shuffles.

    It is written once: a filter on a derived column would else be pushed below it and count tokens again for each use.
    """
    rows = base(spark, sf).select("doc_id", "pile", "source", "lang", "ntok", "n_chars", "h")
    return stored(spark, rows, "annotations").withColumn("band", C.band("ntok"))


# --- scans ------------------------------------------------------------------------------------------------------


@query("scan_nested_flatten", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' AND NOT (contains(text, '<NAME>') OR contains(text, '@mail') OR contains(text, 'password=') OR contains(text, 'AKIA'))")
def scan_nested_flatten(spark, sf):
    """Nested rows (a conversation with its turns) exploded and filtered, as a repository with its files is."""
    turns = table(spark, sf, "conversations")
    nested = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("files"))
    flat = nested.select("conv_id", F.explode("files").alias("f")).select("conv_id", "f.turn", "f.role", "f.text")
    return flat.where((F.col("role") == "user") & ~C.contains_any("text", PII_MARKERS))


@query("scan_line_identity", r"""SELECT doc_id, i - 1 AS line, 'p0:s' || doc_id || ':l' || (i - 1) AS id, md5(l[i]) AS line_md5
FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10)))))::BIGINT AS i FROM documents)""")
def scan_line_identity(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), C.row_id(F.lit(0), "doc_id", "line").alias("id"), F.md5("value").alias("line_md5"))


@query("row_id_parse", "SELECT doc_id, pile::BIGINT AS pile, doc_id % 7 AS shard, doc_id AS line FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS pile FROM documents)")
def row_id_parse(spark, sf):
    rows = base(spark, sf).select("doc_id", C.row_id("pile", F.col("doc_id") % 7, "doc_id").alias("id"))
    return rows.select("doc_id", *[c.alias(n) for n, c in C.parse_row_id("id").items()])


@query("late_materialise", f"""WITH {BASE}, m AS (SELECT doc_id, CASE WHEN ntok % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM base WHERE ntok BETWEEN 64 AND 512)
SELECT d.doc_id, m.split, md5(d.text) AS text_md5 FROM documents d JOIN m USING (doc_id)""")
def late_materialise(spark, sf):
    """Keys first, content only for the rows a manifest names."""
    manifest = slim(spark, sf).where(F.col("ntok").between(64, 512)).select("doc_id", F.when(F.col("ntok") % 10 == 0, "validation").otherwise("train").alias("split"))
    return table(spark, sf, "documents").select("doc_id", "text").join(manifest, "doc_id").select("doc_id", "split", F.md5("text").alias("text_md5"))


@query("projection_by_index", "SELECT row_idx, doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents) WHERE row_idx % 5 = 0")
def projection_by_index(spark, sf):
    """row_idx is the rank in canonical order; only the asked-for columns are read."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    ranked = O.global_rank(spark, rows, ["doc_id"]).withColumn("row_idx", F.col("rank") - 1)
    return ranked.where("row_idx % 5 = 0").select("row_idx", "doc_id", "n_chars")


@query("discovery_grid", """SELECT strftime(d, '%Y-%m-%d') AS start, strftime(d + INTERVAL 20 DAY, '%Y-%m-%d') AS stop, license, lo AS stars_low
FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 21 DAY)) AS d), (SELECT unnest(['mit', 'apache-2.0', 'bsd-3-clause']) AS license), (SELECT unnest([10, 50, 200]) AS lo)""")
def discovery_grid(spark, sf):
    """Cells of a paginated crawl: 21-day windows by license by star band."""
    days = spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-12-31', interval 21 days)")).alias("d"))
    cells = days.withColumn("license", F.explode(F.array(*[F.lit(x) for x in ("mit", "apache-2.0", "bsd-3-clause")]))).withColumn("stars_low", F.explode(F.array(F.lit(10), F.lit(50), F.lit(200))))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return cells.select(day("d").alias("start"), day(F.date_add("d", 20)).alias("stop"), "license", "stars_low")


@query("receipt_scan", "SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def receipt_scan(spark, sf):
    """JSON lines; rows with any key that begins with _ are bookkeeping."""
    text = table(spark, sf, "events").select(F.concat(F.lit('{"'), F.when(F.col("event_type") == "error", "_").otherwise(""), F.lit('id": '), F.col("event_id"), F.lit(', "user": '), F.col("user_id"), F.lit("}")).alias("value"))
    keep = text.where(~F.exists(F.json_object_keys("value"), lambda k: F.startswith(k, F.lit("_"))))
    row = F.from_json("value", "id long, user long")
    return keep.select(row["id"].alias("event_id"), row["user"].alias("user_id"))


# --- features and predicates ---------------------------------------------------------------------------------------


@query("newline_normalise_hash", r"SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '.', chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g')) AS h, sha1(text) AS sha FROM documents")
def newline_normalise_hash(spark, sf):
    crlf = F.replace("text", F.lit("."), F.lit("\r\n"))
    return table(spark, sf, "documents").select("doc_id", C.content_hash(C.newline_normalised(crlf)).alias("h"), F.sha1("text").alias("sha"))


@query("length_gate", "SELECT lang, count(*) AS n FROM documents WHERE length(text) > 200 AND length(text) < 500000 GROUP BY lang")
def length_gate(spark, sf):
    return table(spark, sf, "documents").where((F.length("text") > 200) & (F.length("text") < 500_000)).groupBy("lang").agg(F.count("*").alias("n"))


@query("token_gate", f"WITH {BASE} SELECT lang, count(*) AS n, sum(ntok)::BIGINT AS tokens FROM base WHERE ntok BETWEEN 16 AND 4096 GROUP BY lang")
def token_gate(spark, sf):
    return slim(spark, sf).where(F.col("ntok").between(16, 4096)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("ntok").alias("tokens"))


@query("generated_marker", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(left(text, 400)), '{m}')" for m in MARKERS))
def generated_marker(spark, sf):
    return table(spark, sf, "documents").where(C.generated_marker("text", MARKERS)).select("doc_id")


@query("license_gate", "SELECT event_id FROM events WHERE lower(event_type) IN ('view', 'purchase') OR lower(event_type) = 'signup'")
def license_gate(spark, sf):
    """Allow-list on a lower-cased column."""
    return table(spark, sf, "events").where(F.lower("event_type").isin("view", "purchase", "signup")).select("event_id")


@query("line_shape_metrics", r"""SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS max_line,
len(regexp_extract_all(text, '[ \t\n\r]'))::BIGINT AS n_space, regexp_matches(text, '[0-9A-Za-z]{201}') AS alnum_run FROM documents""")
def line_shape_metrics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in C.line_shape("text").items()])


JUNK = r"""junk AS (SELECT *, (max_line > 1000) AS hard_line, (n_chars > 200 * n_lines) AS soft_mean, (n_space * 20 < n_chars) AS soft_ws, alnum_run AS soft_run FROM
 (SELECT *, len(string_split(text, chr(10))) AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS max_line,
  len(regexp_extract_all(text, '[ \t\n\r]')) AS n_space, regexp_matches(text, '[0-9A-Za-z]{201}') AS alnum_run FROM base)),
flagged AS (SELECT *, hard_line OR (soft_mean::INT + soft_ws::INT + soft_run::INT) >= 2 AS junk FROM junk)"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    shape = C.line_shape("text")
    rows = base(spark, sf).select("doc_id", "pile", "source", "lang", "ntok", "n_chars", "h", *[c.alias(n) for n, c in shape.items()]).withColumn("band", C.band("ntok"))
    rules = C.junk_rules(F.col("n_chars"), F.col("n_lines"), F.col("max_line"), F.col("n_space") * 20, F.col("alnum_run"), F.col("ntok"), F.lit(0.0), space=1)
    return rows.select("*", *[c.alias(n) for n, c in rules.items()])


@query("junk_verdict", f"WITH {BASE}, {JUNK} SELECT doc_id, hard_line, soft_mean, soft_ws, soft_run, junk FROM flagged")
def junk_verdict(spark, sf):
    return flagged(spark, sf).select("doc_id", "hard_line", "soft_mean", "soft_ws", "soft_run", "junk")


@query("junk_rule_counts", f"""WITH {BASE}, {JUNK}, d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY pile, doc_id) > 1 AS dup FROM flagged)
SELECT pile, count(*) AS n, count_if(hard_line)::BIGINT AS hard_line, count_if(soft_mean)::BIGINT AS soft_mean, count_if(soft_ws)::BIGINT AS soft_ws, count_if(junk)::BIGINT AS junk FROM d WHERE NOT dup GROUP BY pile""")
def junk_rule_counts(spark, sf):
    rows = O.first_seen(flagged(spark, sf), "h", ["pile", "doc_id"]).where("NOT dup")
    return rows.groupBy("pile").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("hard_line", "soft_mean", "soft_ws", "junk")])


@query("timestamp_clamp", "SELECT clamped, count(*) AS n, sum(CASE WHEN clamped THEN -1 ELSE floor(epoch(ts))::BIGINT END)::BIGINT AS total FROM (SELECT ts, floor(epoch(ts))::BIGINT > 1705276800 AS clamped FROM events) GROUP BY clamped")
def timestamp_clamp(spark, sf):
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = table(spark, sf, "events").select(ts.alias("ts")).select((F.col("ts") > 1_705_276_800).alias("clamped"), C.clamp_timestamp("ts", 1_705_276_800).alias("t"))
    return rows.groupBy("clamped").agg(F.count("*").alias("n"), F.sum("t").alias("total"))


@query("length_band", f"WITH {BASE} SELECT {BAND} AS band, pile, count(*) AS n FROM base GROUP BY ALL")
def length_band(spark, sf):
    return slim(spark, sf).groupBy("band", "pile").agg(F.count("*").alias("n"))


@query("band_by_pile", f"""WITH {BASE} SELECT {BAND} AS band, count_if(pile = 0)::BIGINT AS p0, count_if(pile = 1)::BIGINT AS p1, count_if(pile = 2)::BIGINT AS p2, count_if(pile = 3)::BIGINT AS p3 FROM base WHERE ntok BETWEEN 16 AND 4096 GROUP BY band""")
def band_by_pile(spark, sf):
    rows = slim(spark, sf).where("band IS NOT NULL").withColumn("p", F.concat(F.lit("p"), F.col("pile")))
    return rows.groupBy("band").pivot("p", ["p0", "p1", "p2", "p3"]).agg(F.count(F.lit(1))).fillna(0)


@query("size_bucket", f"WITH {BASE} SELECT CASE WHEN ntok < 32 THEN 'tiny' WHEN ntok < 64 THEN 'small' WHEN ntok < 256 THEN 'mid' WHEN ntok < 1024 THEN 'large' ELSE 'XL' END AS bucket, count(*) AS n FROM base GROUP BY bucket")
def size_bucket(spark, sf):
    return slim(spark, sf).groupBy(C.size_bucket("ntok").alias("bucket")).agg(F.count("*").alias("n"))


@query("shape_bucket", f"WITH {BASE} SELECT coalesce(list_min(list_filter([64, 128, 256, 512], lambda b: b >= ntok)), (ceil(ntok / 16.0) * 16)::INT)::BIGINT AS width, count(*) AS n FROM base GROUP BY width")
def shape_bucket(spark, sf):
    return slim(spark, sf).groupBy(C.padded_width("ntok", (64, 128, 256, 512)).alias("width")).agg(F.count("*").alias("n"))


@query("slot_ratio", f"WITH {BASE} SELECT pile, sum(ceil(ntok / 4.0) + 2)::BIGINT AS slots, sum(ntok)::BIGINT AS tokens FROM base GROUP BY pile")
def slot_ratio(spark, sf):
    return slim(spark, sf).groupBy("pile").agg(F.sum(C.slot_count("ntok", 4)).alias("slots"), F.sum("ntok").alias("tokens"))


@query("half_split", f"WITH {BASE} SELECT doc_id, greatest(ntok // 2, 16)::BIGINT AS mid FROM base")
def half_split(spark, sf):
    return slim(spark, sf).select("doc_id", C.half("ntok").alias("mid"))


@query("exemplar_counts", r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s"''<>]+'))::BIGINT AS url, len(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'))::BIGINT AS date,
len(regexp_extract_all(text, '\b\d+\.\d+\.\d+\b'))::BIGINT AS version, len(regexp_extract_all(text, '\b0x[0-9a-fA-F]+\b'))::BIGINT AS hex, len(regexp_extract_all(text, '\b\d{5,}\b'))::BIGINT AS number FROM documents""")
def exemplar_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in C.exemplar_counts("text").items()])


@query("prose_strip", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)\"\"\"(.*?)\"\"\"|''''''(.*?)''''''', '""', 'g'), '#[^\n]*', '', 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{2,}', chr(10), 'g')) AS h FROM pages""".replace('\\"', '"'))
def prose_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(C.prose_stripped("html")).alias("h"))


@query("docstring_text", r"""SELECT p_partkey, CASE WHEN length(d) >= 8 THEN d END AS doc, CASE p_size % 3 WHEN 0 THEN 'Google style' WHEN 1 THEN 'Sphinx/reST style' ELSE 'plain prose' END AS style,
CASE WHEN p_size % 3 = 0 THEN ['KeyError', 'ValueError'] END AS raises FROM (SELECT *, trim(regexp_replace(p_name || CASE p_size % 3 WHEN 0 THEN ' Args: x Raises: ValueError: a KeyError: b' WHEN 1 THEN ' :param x: y' ELSE ' text' END, '\s+', ' ', 'g')) AS d FROM part)""")
def docstring_text(spark, sf):
    tail = F.when(F.col("p_size") % 3 == 0, "\n\n  Args:\n x\n Raises:\n ValueError: a\n KeyError: b\n").when(F.col("p_size") % 3 == 1, "\n :param x: y").otherwise(" text")
    code = F.concat(F.lit('def f(x):\n    """'), F.col("p_name"), tail, F.lit('"""\n    return x\n'))
    doc = F.regexp_extract(code, C.TRIPLE, 1)
    return table(spark, sf, "part").select("p_partkey", C.regex_docstring(code).alias("doc"), C.docstring_style(doc).alias("style"), C.documented_raises(doc).alias("raises"))


@query("def_name", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'fn' || p_partkey ELSE 'part_' || p_partkey END AS name, 'part_' || p_partkey AS short FROM part")
def def_name(spark, sf):
    code = F.when(F.col("p_size") % 4 == 0, F.lit("x = 1")).otherwise(F.concat(F.when(F.col("p_size") % 4 == 1, "async def part_").otherwise("def part_"), F.col("p_partkey"), F.lit("(a):")))
    return table(spark, sf, "part").select("p_partkey", C.def_name(code, "p_partkey").alias("name"), C.short_name(F.concat(F.lit("mod.Cls.part_"), F.col("p_partkey"))).alias("short"))


# --- exclusion, dedup, status ----------------------------------------------------------------------------------------


@query("decontaminate_hash", f"""WITH {BASE}, e AS (SELECT DISTINCT h FROM base WHERE doc_id % 50 = 0), r AS (SELECT lower(source) AS repo FROM documents GROUP BY 1 HAVING min(doc_id) = 0)
SELECT doc_id, h IN (SELECT h FROM e) AS excl_hash, lower(source) IN (SELECT repo FROM r) AS excl_repo FROM base""")
def decontaminate_hash(spark, sf):
    """Labelled exclusion by content hash and lower-cased repo; empty lists fail."""
    rows = slim(spark, sf).withColumnRenamed("source", "repo")
    hashes = rows.where("doc_id % 50 = 0").select("h")
    repos = rows.groupBy("repo").agg(F.min("doc_id").alias("m")).where("m = 0").select("repo")
    return O.excluded(rows, hashes, repos).select("doc_id", "excl_hash", "excl_repo")


@query("decontaminate_substring", "SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def decontaminate_substring(spark, sf):
    """Documents that hold a whole item."""
    heads = table(spark, sf, "benchmark").where("text IS NOT NULL").select(F.col("text").alias("head")).distinct()
    return O.containing(table(spark, sf, "documents"), heads)


@query("split_leakage", f"""WITH {BASE}, s AS (SELECT doc_id, h, source, CASE WHEN doc_id % 10 = 0 THEN 'validation' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM base),
k AS (SELECT *, row_number() OVER (PARTITION BY split, h ORDER BY doc_id) AS rn FROM s)
SELECT split, count(*) AS n FROM k WHERE rn = 1 AND NOT (split = 'train' AND h IN (SELECT h FROM k WHERE split <> 'train')) GROUP BY split""")
def split_leakage(spark, sf):
    split = F.when(F.col("doc_id") % 10 == 0, "validation").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    kept = O.eval_first_dedup(slim(spark, sf).select("doc_id", "h", split.alias("split")), "h", "split", ["doc_id"])
    return kept.groupBy("split").agg(F.count("*").alias("n"))


@query("split_overlap", """WITH s AS (SELECT DISTINCT lang, CASE WHEN doc_id % 10 = 0 THEN 'validation' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT a.split AS a, b.split AS b, count(*) AS shared FROM s a JOIN s b ON a.lang = b.lang AND a.split < b.split GROUP BY ALL""")
def split_overlap(spark, sf):
    """Groups (here languages) that any two splits share."""
    split = F.when(F.col("doc_id") % 10 == 0, "validation").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    s = table(spark, sf, "documents").select("lang", split.alias("split")).distinct()
    a, b = s.toDF("lang", "a"), s.toDF("lang", "b")
    return a.join(b, "lang").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("dedup_first_seen", f"WITH {BASE} SELECT doc_id, pile FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY pile, doc_id) AS rn FROM base) WHERE rn = 1")
def dedup_first_seen(spark, sf):
    return O.dedup(slim(spark, sf), "h", ["pile", "doc_id"]).select("doc_id", "pile")


@query("dedup_after_gates", f"WITH {BASE} SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM base WHERE ntok BETWEEN 64 AND 512) WHERE rn = 1")
def dedup_after_gates(spark, sf):
    """A hash is remembered only once its row has passed the gates."""
    return O.dedup(slim(spark, sf).where(F.col("ntok").between(64, 512)), "h", ["doc_id"]).select("doc_id")


STATUS = f"""{BASE}, {JUNK}, st AS (SELECT *, CASE WHEN h IN (SELECT h FROM base WHERE doc_id % 50 = 0) THEN 'excl_hash' WHEN lower(source) IN ('src7') THEN 'excl_repo'
  WHEN row_number() OVER (PARTITION BY h ORDER BY pile, doc_id) > 1 THEN 'dup' WHEN junk THEN 'junk' ELSE 'eligible' END AS status FROM flagged)"""


def statused(spark: SparkSession, sf: str) -> DataFrame:
    rows = flagged(spark, sf).withColumn("repo", F.col("source"))
    hashes = base(spark, sf).where("doc_id % 50 = 0").select("h")
    repos = spark.createDataFrame([("SRC7",)], "repo string")
    return O.status(O.first_seen(O.excluded(rows, hashes, repos), "h", ["pile", "doc_id"]))


@query("status_precedence", f"WITH {STATUS} SELECT pile, status, count(*) AS n FROM st GROUP BY pile, status")
def status_precedence(spark, sf):
    return statused(spark, sf).groupBy("pile", "status").agg(F.count("*").alias("n"))


@query("reject_list", f"WITH {STATUS} SELECT 'p' || pile || ':s0:l' || doc_id AS id, lang AS pile_name, status AS reason FROM st WHERE status <> 'eligible'")
def reject_list(spark, sf):
    """Every dropped row once, with one reason."""
    rows = statused(spark, sf).where("status <> 'eligible'")
    return rows.select(C.row_id("pile", F.lit(0), "doc_id").alias("id"), F.col("lang").alias("pile_name"), F.col("status").alias("reason"))


# --- families, caps, draws ----------------------------------------------------------------------------------------------

FAMILY = rf"""fam AS (SELECT doc_id, source AS repo, ntok, md5(array_to_string(list_transform(regexp_extract_all(text, '([0-9A-Za-z_]+|[^0-9A-Za-z_\s])'),
  lambda x: CASE WHEN x IN {KEYWORDS} THEN x WHEN regexp_matches(x, '^[0-9]') THEN '0' WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'N' ELSE x END), ' ')) AS fam FROM base)"""


def families(spark: SparkSession, sf: str) -> DataFrame:
    """The family of a document is the skeleton of its whole text."""
    rows = base(spark, sf).select("doc_id", F.col("source").alias("repo"), "ntok", F.md5(C.skeleton("text", KEYWORDS)).alias("fam"))
    return stored(spark, rows, "families")


@query("family_stats", f"WITH {BASE}, {FAMILY} SELECT fam, count(*) AS size, count(DISTINCT lower(repo)) AS n_repos, count(DISTINCT lower(repo)) >= {FAMILY_REPOS} AS boilerplate FROM fam GROUP BY fam")
def family_stats(spark, sf):
    return O.family_stats(families(spark, sf), FAMILY_REPOS)


@query("family_top", f"WITH {BASE}, {FAMILY} SELECT fam, count(*) AS size, count(DISTINCT lower(repo)) AS n_repos, min(doc_id) AS example FROM fam GROUP BY fam ORDER BY size DESC, fam LIMIT 50")
def family_top(spark, sf):
    agg = families(spark, sf).groupBy("fam").agg(F.count("*").alias("size"), F.countDistinct(F.lower("repo")).alias("n_repos"), F.min("doc_id").alias("example"))
    return agg.orderBy(F.desc("size"), "fam").limit(50)


@query("repo_cap", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= {REPO_CAP}")
def repo_cap(spark, sf):
    return O.capped(table(spark, sf, "documents").select("doc_id", "source"), "source", REPO_CAP, ["doc_id"]).select("doc_id")


@query("band_quota", f"WITH {BASE} SELECT doc_id, band FROM (SELECT doc_id, {BAND} AS band, row_number() OVER (PARTITION BY {BAND} ORDER BY doc_id) AS rn FROM base WHERE ntok BETWEEN 16 AND 4096) WHERE rn <= {BAND_QUOTA}")
def band_quota(spark, sf):
    return O.capped(slim(spark, sf).where("band IS NOT NULL"), "band", BAND_QUOTA, ["doc_id"]).select("doc_id", "band")


@query("cap_cascade", f"""WITH {BASE}, {FAMILY}, a AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS r FROM fam),
b AS (SELECT *, row_number() OVER (PARTITION BY fam, r <= {REPO_CAP} ORDER BY doc_id) AS f FROM a)
SELECT doc_id, CASE WHEN r > {REPO_CAP} THEN 'cap_repo' WHEN f > 20 THEN 'cap_family' ELSE 'kept' END AS status FROM b""")
def cap_cascade(spark, sf):
    return O.cap_cascade(families(spark, sf), [("cap_repo", REPO_CAP, "repo"), ("cap_family", 20, "fam")], ["doc_id"]).select("doc_id", "status")


@query("val_repo_reservation", f"""WITH {BASE}, s AS (SELECT source AS repo, count_if({BAND} = 0)::BIGINT AS b0, count_if({BAND} = 1)::BIGINT AS b1, count_if({BAND} = 2)::BIGINT AS b2 FROM base GROUP BY source),
o AS (SELECT *, row_number() OVER w AS place, coalesce(sum(b0) OVER p, 0) AS c0, coalesce(sum(b1) OVER p, 0) AS c1, coalesce(sum(b2) OVER p, 0) AS c2 FROM s
 WINDOW w AS (ORDER BY md5('val|' || repo), repo), p AS (ORDER BY md5('val|' || repo), repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT repo, b0, b1, b2, place::INT AS place FROM o WHERE c0 < 5 OR c1 < 40 OR c2 < 60""")
def val_repo_reservation(spark, sf):
    return O.reserve_repos(slim(spark, sf).withColumnRenamed("source", "repo"), {0: 5, 1: 40, 2: 60})


VAL_TARGETS, TARGETS = {1: 10, 2: 15}, {0: 200, 1: 400, 2: 400, 3: 50, 4: 50}


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """What the draw reads; reserved: the repositories whose supply outside the first pile is twice the targets of validation.

    Each text is searched for tokens once: its skeleton has one run for each, between spaces.
    """
    shapes = base(spark, sf).where("doc_id IS NOT NULL").select("doc_id", "pile", F.col("source").alias("repo"), C.skeleton("text", KEYWORDS).alias("shape"))
    ntok = F.when(F.col("shape") == "", 0).otherwise(F.length("shape") - F.length(F.replace("shape", F.lit(" "), F.lit(""))) + 1)
    known = stored(spark, shapes.select("doc_id", "pile", "repo", ntok.cast("long").alias("ntok"), F.md5("shape").alias("fam")), "annotations").withColumn("band", C.band("ntok"))
    stats = O.family_stats(known, FAMILY_REPOS).select("fam", "boilerplate")
    rows = known.where("band IS NOT NULL").join(stats, "fam")
    reserved = O.reserve_repos(rows.where("pile <> 0"), {b: 2 * n for b, n in VAL_TARGETS.items()}).select("repo", F.lit(True).alias("reserved"))
    rows = rows.join(reserved, "repo", "left").fillna(False, ["reserved"])
    return stored(spark, rows.select(F.col("doc_id").alias("id"), "repo", "fam", "boilerplate", (F.col("ntok") < 40).alias("stub"), "band", "reserved", "pile"), "draw-input")


@query("draw_exact")
def draw_exact(spark, sf):
    """The sequential draw with its phases and interacting caps."""
    rows = draw.draw(spark, drawn(spark, sf), TARGETS, VAL_TARGETS, 40, 20, 0.2)
    return rows.select(F.col("id").alias("doc_id"), "repo", "band", "phase", "status")


@query("style_means", """SELECT lang, count(*) AS n, sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic, floor(10000.0 * sum(quality) / count(*) + 0.5) / 10000 AS quality_mean FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def style_means(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    agg = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    return agg.withColumn("quality_mean", F.floor(10_000 * F.col("quality") / F.col("n") + 0.5) / 10_000)


@query("post_date_share", "SELECT event_type, count_if(ts >= TIMESTAMP '2024-01-15')::BIGINT AS late, count(*) AS n, count_if(ts >= TIMESTAMP '2024-01-15') / greatest(count(*), 1) AS share FROM events GROUP BY event_type")
def post_date_share(spark, sf):
    late = F.count_if(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    return table(spark, sf, "events").groupBy("event_type").agg(late.alias("late"), F.count("*").alias("n"), (late / F.greatest(F.count("*"), F.lit(1))).alias("share"))


CONCENTRATION = """WITH c AS (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1), r AS (SELECT n, sum(n) OVER (ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
 row_number() OVER (ORDER BY n DESC, k) AS place, greatest(1, count(*) OVER () // 100) AS top FROM c)
SELECT count(*) AS n_keys, sum(n)::BIGINT AS n_rows, sum(CASE WHEN place <= top THEN n ELSE 0 END)::BIGINT AS top_rows, sum(cum)::BIGINT AS sum_cum,
 abs(1 - 2 * sum(cum) / (sum(n) * count(*)) + 1 / count(*)) AS gini, sum(CASE WHEN place <= top THEN n ELSE 0 END) / sum(n) AS top_share FROM r"""


@query("repo_gini", CONCENTRATION.format(key="source || '/' || lang", table="documents"))
def repo_gini(spark, sf):
    return O.concentration(table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("k")), "k")


@query("user_concentration", CONCENTRATION.format(key="user_id", table="events"))
def user_concentration(spark, sf):
    return O.concentration(table(spark, sf, "events").select(F.col("user_id").alias("k")), "k")


@query("repo_top", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 30")
def repo_top(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(30)


@query("token_stats", f"WITH {BASE} SELECT lang, sum(ntok)::BIGINT AS total, avg(ntok) AS mean, quantile_cont(ntok, 0.5) AS median FROM base GROUP BY lang")
def token_stats(spark, sf):
    return slim(spark, sf).groupBy("lang").agg(F.sum("ntok").alias("total"), F.avg("ntok").alias("mean"), F.percentile("ntok", 0.5).alias("median"))


@query("parent_roundtrip", """WITH s AS (SELECT doc_id, source, lang, octet_length(encode(text)) AS nb FROM documents)
SELECT doc_id AS span_id, doc_id % 15 <> 0 AS ok, (SELECT count(*) FROM documents f WHERE f.source = s.source AND f.lang = s.lang AND f.doc_id <= s.doc_id) AS parents FROM s""")
def parent_roundtrip(spark, sf):
    """Byte spans cut from documents, every fifteenth of them damaged, against every candidate parent of the same source and language: the documents up to its own."""
    docs = table(spark, sf, "documents")
    half, raw = F.floor(F.octet_length("text") / 2).cast("int"), F.encode("text", "UTF-8")
    cut = raw.substr(F.lit(1), half)
    code = F.when(F.col("doc_id") % 15 == 0, F.concat(cut, F.encode(F.lit("~"), "UTF-8"))).otherwise(cut)
    spans = docs.select(F.col("doc_id").alias("span_id"), "doc_id", "source", "lang", F.lit(0).alias("start"), half.alias("end"), code.alias("code"))
    return O.slice_at(spark, docs.select("doc_id", "source", "lang", F.col("text").alias("content")), spans, ["source", "lang"], upto="doc_id")


# --- samples, limits, windows ---------------------------------------------------------------------------------------------


@query("uniform_sample", "SELECT doc_id FROM documents ORDER BY md5('s|' || doc_id), doc_id LIMIT 150")
def uniform_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(C.hash_order("s", "doc_id"), "doc_id").limit(150)


@query("stratified_sample", f"WITH {BASE} SELECT doc_id, band FROM (SELECT doc_id, {BAND} AS band, row_number() OVER (PARTITION BY {BAND} ORDER BY md5('b|' || doc_id), doc_id) AS rn FROM base WHERE ntok BETWEEN 16 AND 4096) WHERE rn <= CASE band WHEN 0 THEN 5 WHEN 1 THEN 30 ELSE 15 END")
def stratified_sample(spark, sf):
    rows = slim(spark, sf).where("band IS NOT NULL")
    picked = O.first_per_group(rows, ["band"], [C.hash_order("b", "doc_id"), "doc_id"], 30)
    return picked.where(F.col("rn") <= F.when(F.col("band") == 0, 5).when(F.col("band") == 1, 30).otherwise(15)).select("doc_id", "band")


@query("topk_per_group", "SELECT source, doc_id, left(text, 2000) AS example FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 20")
def topk_per_group(spark, sf):
    return O.first_per_group(table(spark, sf, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 20).select("source", "doc_id", F.left("text", F.lit(2000)).alias("example"))


@query("round_robin_limit", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 77")
def round_robin_limit(spark, sf):
    return O.round_robin(table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 77).select("source", "doc_id")


@query("mixture_draw", """WITH g AS (SELECT s AS step, r AS rank, ('0x' || substr(md5('mix|' || s || '|' || r), 1, 12))::BIGINT / 281474976710656.0 AS u FROM (SELECT unnest(generate_series(0, 499)) AS s), (SELECT unnest(generate_series(0, 7)) AS r))
SELECT CASE WHEN u < 0.5 THEN 'recon' WHEN u < 0.8 THEN 'qa' ELSE 'span' END AS task, count(*) AS n FROM g GROUP BY task""")
def mixture_draw(spark, sf):
    """A weighted task for each (step, rank), from a hash and so the same on every run."""
    grid = spark.range(500).select(F.col("id").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("rank"))
    u = C.uniform("mix", "step", "rank")
    return grid.groupBy(F.when(u < 0.5, "recon").when(u < 0.8, "qa").otherwise("span").alias("task")).agg(F.count("*").alias("n"))


@query("sort_multi_key", f"WITH {BASE} SELECT doc_id, row_number() OVER (ORDER BY pile, ntok DESC, doc_id)::INT AS place FROM base")
def sort_multi_key(spark, sf):
    rows = slim(spark, sf).select("doc_id", "pile", "ntok")
    return O.global_rank(spark, rows, ["pile", F.desc("ntok"), "doc_id"]).select("doc_id", F.col("rank").cast("int").alias("place"))


@query("length_window", f"WITH {BASE} SELECT doc_id, ntok FROM (SELECT doc_id, ntok, row_number() OVER (ORDER BY ntok, doc_id) AS rn FROM base) WHERE rn BETWEEN 101 AND 132")
def length_window(spark, sf):
    """A contiguous window of the length-sorted table."""
    rows = O.global_rank(spark, slim(spark, sf).select("doc_id", "ntok"), ["ntok", "doc_id"], "rn")
    return rows.where("rn BETWEEN 101 AND 132").select("doc_id", "ntok")


@query("budget_windows", f"WITH {BASE}, w AS (SELECT doc_id, source, ntok, sum(ntok) OVER (PARTITION BY source ORDER BY ntok, doc_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY source ORDER BY ntok, doc_id) AS rn FROM base) SELECT doc_id, source, cum::BIGINT AS cum FROM w WHERE cum <= 4000 OR rn = 1")
def budget_windows(spark, sf):
    return O.budget_prefix(slim(spark, sf), ["source"], "ntok", ["ntok", "doc_id"], 4000).select("doc_id", "source", "cum")


@query("budget_skip", f"""WITH RECURSIVE {BASE}, r AS (SELECT source, doc_id, ntok, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM base),
f AS (SELECT source, 1::BIGINT AS rn, ntok AS total, 1 AS kept, TRUE AS taken, doc_id FROM r WHERE rn = 1
 UNION ALL SELECT r.source, r.rn, CASE WHEN f.kept < 2 OR f.total + r.ntok <= 3000 THEN f.total + r.ntok ELSE f.total END, CASE WHEN f.kept < 2 OR f.total + r.ntok <= 3000 THEN f.kept + 1 ELSE f.kept END,
  f.kept < 2 OR f.total + r.ntok <= 3000, r.doc_id FROM f JOIN r ON r.source = f.source AND r.rn = f.rn + 1)
SELECT source, doc_id FROM f WHERE taken""")
def budget_skip(spark, sf):
    """Stack budget: at least two, then a row that would overflow is skipped and the next one tried."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "ntok"))), lambda x: F.struct(x["doc_id"].alias("id"), x["ntok"].alias("size")))
    rows = slim(spark, sf).groupBy("source").agg(items.alias("items"))
    return rows.select("source", F.explode(O.budget_skip(F.col("items"), 3000)).alias("doc_id"))


@query("run_dedup", """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id, event_type FROM l WHERE p IS DISTINCT FROM event_type""")
def run_dedup(spark, sf):
    """One row of each contiguous run."""
    rows = O.runs(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return rows.groupBy("user_id", "run").agg(F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("f")).select("f.event_id", "user_id", "f.event_type")


@query("reservoir_substitute", """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT event_id, event_type FROM l WHERE p IS DISTINCT FROM event_type)
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('res|' || event_id), event_id) AS rn FROM s) WHERE rn <= 40""")
def reservoir_substitute(spark, sf):
    """A uniform sample of runs per intent: hash order in place of a seeded reservoir."""
    return O.first_per_group(run_dedup(spark, sf), ["event_type"], [C.hash_order("res", "event_id"), "event_id"], 40).select("event_id", "event_type")


@query("waterfill_quota", "SELECT lang, least(count(*), 100)::BIGINT AS target FROM documents GROUP BY lang")
def waterfill_quota(spark, sf):
    """Allocation over aggregated supply: a handful of rows on the driver."""
    supply = {r.lang: min(r["count"], 100) for r in table(spark, sf, "documents").groupBy("lang").count().collect()}
    return spark.createDataFrame(sorted(O.water_fill(supply, 400).items()), "lang string, target long")


@query("quota_table", """SELECT lang, source, count(*) AS supply, grouping(source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source) HAVING lang IS NOT NULL""")
def quota_table(spark, sf):
    rolled = table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("supply"), F.grouping("source").cast("long").alias("level"))
    return rolled.where("lang IS NOT NULL")


@query("coverage_report", """WITH q(lang, quota) AS (VALUES ('en', 300), ('fr', 200), ('de', 100), ('es', 400)), s AS (SELECT lang, count(*) AS n, count(*) * 100 AS projected FROM documents GROUP BY lang)
SELECT lang, n, projected, quota, projected < 15000 AS low_supply, CASE WHEN n >= quota THEN 'OK' ELSE 'SHORT' END AS verdict FROM s JOIN q USING (lang)""")
def coverage_report(spark, sf):
    quota = spark.createDataFrame([("en", 300), ("fr", 200), ("de", 100), ("es", 400)], "lang string, quota int")
    s = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("projected", F.col("n") * 100)
    return s.join(quota, "lang").select("lang", "n", "projected", "quota", (F.col("projected") < 15_000).alias("low_supply"), F.when(F.col("n") >= F.col("quota"), "OK").otherwise("SHORT").alias("verdict"))


@query("distractor_pool", r"SELECT DISTINCT split_part(text, chr(10), 1) AS line FROM documents WHERE length(split_part(text, chr(10), 1)) BETWEEN 15 AND 160")
def distractor_pool(spark, sf):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf, "documents").select(line.alias("line")).where(F.length("line").between(15, 160)).distinct()


@query("foreign_fillers", """SELECT a.source AS grp, b.doc_id FROM (SELECT DISTINCT source FROM documents WHERE lang = 'fr') a JOIN (SELECT doc_id, source FROM documents WHERE lang = 'es' ORDER BY md5('f|' || doc_id), doc_id LIMIT 20) b ON a.source <> b.source""")
def foreign_fillers(spark, sf):
    """Rows of other groups; both sides are bounded (the groups, and 20 fillers)."""
    groups = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("source").alias("grp")).distinct()
    fillers = table(spark, sf, "documents").where("lang = 'es'").select("doc_id", "source").orderBy(C.hash_order("f", "doc_id"), "doc_id").limit(20)
    packed = fillers.agg(F.collect_list(F.struct("doc_id", "source")).alias("all"))
    return groups.join(packed, F.lit(True)).select("grp", F.explode("all").alias("x")).where("grp <> x.source").select("grp", "x.doc_id")


@query("set_operations", """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)
UNION ALL SELECT 'except', count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT text FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'union', count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 UNION SELECT text FROM documents WHERE doc_id % 2 = 1)""")
def set_operations(spark, sf):
    a, b = (table(spark, sf, "documents").where(f"doc_id % 2 = {i}").select(F.md5("text").alias("h")) for i in (0, 1))
    counted = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return counted("intersect", a.intersect(b)).unionByName(counted("except", a.subtract(b))).unionByName(counted("union", a.union(b).distinct()))


@query("cyclic_decoy", "SELECT doc_id, coalesce(lead(source) OVER (ORDER BY doc_id), first_value(source) OVER (ORDER BY doc_id)) AS decoy FROM documents")
def cyclic_decoy(spark, sf):
    return O.cyclic_next(spark, table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", "decoy").select("doc_id", "decoy")


@query("unique_key_join", "WITH u AS (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) = 1) SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM u)")
def unique_key_join(spark, sf):
    return O.unique_only(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


@query("picker_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 40")
def picker_filter(spark, sf):
    return table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id").orderBy("doc_id").limit(40)


#: A class: copies (equal stripped texts) of one family and repository; its representative is the smallest of them.
CLASSES = f"""{FAMILY}, k AS (SELECT fam.doc_id, fam, repo, h FROM fam JOIN base ON base.doc_id = fam.doc_id), c AS (SELECT fam, repo, h, min(doc_id) AS id, count(*) AS n FROM k GROUP BY ALL)"""


def copy_classes(spark: SparkSession, sf: str) -> DataFrame:
    """id, fam, repo, h, class."""
    rows = base(spark, sf).select(F.col("doc_id").alias("id"), F.md5(C.skeleton("text", KEYWORDS)).alias("fam"), F.col("source").alias("repo"), "h")
    return similar.classes(stored(spark, rows, "copies"), ["fam", "repo", "h"])


@query("family_pairs", f"""WITH {BASE}, {FAMILY} SELECT a.fam AS fam, a.doc_id AS a, b.doc_id AS b FROM fam a JOIN fam b ON a.fam = b.fam AND a.doc_id < b.doc_id AND a.repo <> b.repo""")
def family_pairs(spark, sf):
    """Twin candidates: all pairs of documents of one family and different repositories, copies too."""
    rows = families(spark, sf).select(F.col("fam").alias("key"), F.col("doc_id").alias("id"), F.col("repo").alias("side"))
    several = rows.groupBy("key").agg((F.min("side") != F.max("side")).alias("_several")).where("_several").select("key")
    pairs = several.select(F.col("key").alias("fam"), F.col("key").alias("x"), F.col("key").alias("y"))
    return similar.linked(spark, pairs, rows.join(several, "key", "left_semi"))


@query("family_classes", f"WITH {BASE}, {CLASSES} SELECT doc_id, c.id AS class FROM k JOIN c ON k.fam = c.fam AND k.repo IS NOT DISTINCT FROM c.repo AND k.h IS NOT DISTINCT FROM c.h")
def family_classes(spark, sf):
    """The class of every document: copies of one family and repository."""
    return copy_classes(spark, sf).select(F.col("id").alias("doc_id"), "class")


#: Documents with their token sets; those of a family and a repository that agree on the set and on how alike a partner must be are one class.
SETS = f"""{FAMILY}, t AS (SELECT fam, repo, doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))) AS toks, CASE WHEN ntok < 8 THEN 0.90 WHEN ntok < 20 THEN 0.75 ELSE 0.65 END AS floor FROM fam JOIN documents USING (doc_id)),
c AS (SELECT fam, repo, toks, floor, min(doc_id) AS id, count(*) AS n FROM t GROUP BY ALL)"""


def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    """id, fam, repo, floor, elements and set, their digest."""
    rows = base(spark, sf).select(F.col("doc_id").alias("id"), F.md5(C.skeleton("text", KEYWORDS)).alias("fam"), F.col("source").alias("repo"), C.similarity_floor("ntok").alias("floor"), F.array_sort(F.array_distinct(C.rouge_tokens("text"))).alias("elements"))
    return stored(spark, rows.withColumn("set", F.md5(F.array_join("elements", " "))), "token-sets")


def token_classes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """id, fam, repo, floor, set, class; the tokens themselves stay behind."""
    return stored(spark, similar.classes(rows.drop("elements"), ["fam", "repo", "set", "floor"]), "token-classes")


def similar_classes(spark: SparkSession, sf: str) -> DataFrame:
    """fam, a, b, sim, n_a, n_b: pairs of classes by their representatives. A family of one repository has no pair, and its tokens aren't looked at."""
    sets = token_sets(spark, sf)
    rows = token_classes(spark, sets)
    several = rows.groupBy("fam").agg((F.min("repo") != F.max("repo")).alias("_several")).where("_several").select("fam")
    ids = rows.where("id = class").join(several, "fam", "left_semi").select("id")
    reps = sets.join(ids, "id", "left_semi").select(F.col("fam").alias("grp"), "id", F.col("repo").alias("side"), "elements", "floor")
    counts = rows.groupBy("class").agg(F.count("*").alias("n"))
    n = lambda x: counts.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"))
    return similar.similar_sets(spark, reps).withColumnRenamed("grp", "fam").join(n("a"), "a").join(n("b"), "b")


def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, sim: pairs of documents. Sets are compared once for each family and floor, and the documents that have them are linked."""
    sets = token_sets(spark, sf)
    # as in SQL, an id that comes twice has each of its families with each of its sets
    rows = sets.select("id", "fam", "repo", "floor").join(sets.select("id", "set"), "id").where("fam IS NOT NULL AND repo IS NOT NULL AND set IS NOT NULL")
    several = rows.groupBy("fam").agg((F.min("repo") != F.max("repo")).alias("_several")).where("_several").select("fam")
    rows = stored(spark, rows.join(several, "fam", "left_semi"), "set-rows")
    kinds = rows.groupBy("fam", "set", "floor").agg(F.min("id").alias("id"), F.min("repo").alias("_from"), F.max("repo").alias("_to"))
    once = F.count("*").over(Window.partitionBy("fam", "id")) == 1  # else the name is one that no document has
    kinds = kinds.withColumn("key", F.when(once, F.col("id")).otherwise(F.lit(-(1 << 63)) + F.monotonically_increasing_id()))
    kinds = stored(spark, kinds.withColumn("_kinds", F.count("*").over(Window.partitionBy("fam"))).drop("id"), "set-kinds")
    compared = kinds.where("_kinds > 1")
    # most sets are compared with no other: a million marks at most tell which tokens needn't be dealt out
    mark = F.pmod(F.xxhash64("set"), F.lit(1 << 20)).alias("_mark")
    wanted = sets.select("set", "elements", mark).join(F.broadcast(compared.select(mark).distinct()), "_mark", "left_semi")
    elements = wanted.groupBy("set").agg(F.any_value("elements").alias("elements"))
    # sets that one and the same repository alone has give no pair
    side = F.when(F.col("_from") == F.col("_to"), F.concat(F.lit("r"), "_from")).otherwise(F.concat(F.lit("k"), "key"))
    reps = compared.join(elements, "set").select(F.col("fam").alias("grp"), F.col("key").alias("id"), side.alias("side"), "elements", "floor")
    pairs = similar.similar_sets(spark, reps).select(F.col("a").alias("x"), F.col("b").alias("y"), "sim")
    same = kinds.where((F.col("_from") != F.col("_to")) & (F.col("set") != F.md5(F.lit("")))).select(F.col("key").alias("x"), F.col("key").alias("y"), F.lit(1.0).alias("sim"))
    members = rows.join(kinds, ["fam", "set", "floor"]).select("key", "id", F.col("repo").alias("side"))
    return similar.linked(spark, pairs.unionByName(same), members).select("a", "b", "sim")


@query("jaccard_pairs", f"""WITH {BASE}, {FAMILY}, t AS (SELECT f.*, list_distinct(regexp_extract_all(lower(d.text), '([a-z0-9_]+)', 1)) AS toks FROM fam f JOIN documents d USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0 ELSE len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END AS sim,
 CASE WHEN least(a.ntok, b.ntok) < 8 THEN 0.90 WHEN least(a.ntok, b.ntok) < 20 THEN 0.75 ELSE 0.65 END AS floor FROM t a JOIN t b ON a.fam = b.fam AND a.doc_id < b.doc_id AND a.repo <> b.repo)
SELECT a, b, sim FROM p WHERE sim >= floor""")
def jaccard_pairs(spark, sf):
    """Similar documents of a family from different repositories: all pairs, copies too."""
    return similar_documents(spark, sf)


@query("jaccard_classes", f"WITH {BASE}, {SETS} SELECT doc_id, c.id AS class FROM t JOIN c ON t.fam = c.fam AND t.repo IS NOT DISTINCT FROM c.repo AND t.toks = c.toks AND t.floor = c.floor")
def jaccard_classes(spark, sf):
    """The class of every document: rows of a family and a repository that agree on the token set and the floor."""
    return token_classes(spark, token_sets(spark, sf)).select(F.col("id").alias("doc_id"), "class")


@query("twins_greedy")
def twins_greedy(spark, sf):
    """Best-first disjoint pairs of representatives per family."""
    return O.disjoint_pairs(similar_classes(spark, sf).select("fam", "a", "b", "sim"))


#: Pairs of classes.
CLASS_PAIRS = f"""WITH {BASE}, {SETS},
p AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CASE WHEN a.id < b.id THEN a.n ELSE b.n END AS n_a, CASE WHEN a.id < b.id THEN b.n ELSE a.n END AS n_b, greatest(a.floor, b.floor) AS floor,
 CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0 ELSE len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END AS sim FROM c a JOIN c b ON a.fam = b.fam AND a.id < b.id AND a.repo <> b.repo)
SELECT a, b, sim, n_a, n_b FROM p WHERE sim >= floor"""


@query("similarity_percentiles", f"WITH p AS ({CLASS_PAIRS}) SELECT count(*) AS n, quantile_cont(sim, 0.1) AS p10, quantile_cont(sim, 0.5) AS p50, quantile_cont(sim, 0.9) AS p90 FROM p")
def similarity_percentiles(spark, sf):
    return similar_classes(spark, sf).agg(F.count("*").alias("n"), *[F.percentile("sim", q / 100).alias(f"p{q}") for q in (10, 50, 90)])


@query("stacks_greedy")
def stacks_greedy(spark, sf):
    """Stacks of eight with unique names."""
    return O.stacks(spark, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("_", "source", "lang").alias("name")))
