"""The registered queries of this subpackage and, where SQL can express one, its DuckDB query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_extract, mixing, pii, pu_classifier, quality_rules, secret_scan, simhash, spelling, substring_dedup, token_counts, warc
from .common import documents

WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return quality_rules.judge(spark, documents(spark, sf_dir, "doc_id", "text")).select(*first)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(spark, documents(spark, sf_dir, "doc_id", "text"), benchmark)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.classify(spark, documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(spark, documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir, "doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, documents(spark, sf_dir, "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(spark, documents(spark, sf_dir, "doc_id", "text"), pii.session_key(spark), counted=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark, documents(spark, sf_dir, "doc_id", "text"), noise=199)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, documents(spark, sf_dir, "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"))
    return hard_negatives.mine(spark, rows, rows.where("id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}

#: crc32 of UTF-8 text as SQL: its 256-entry table from the polynomial, then one step for each byte.
CRC_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
CRC_TABLE = f"SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: {CRC_STEP}, i) AS c FROM (SELECT unnest(range(256)) AS i))"

ORACLES: dict[str, str] = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM each, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word),
form AS (SELECT word, min(other) AS form, other_n FROM near JOIN best USING (word) WHERE other_n = m GROUP BY word, other_n),
named AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * w.n THEN form END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
          FROM words w LEFT JOIN best USING (word) LEFT JOIN form USING (word)),
up AS (SELECT word, word AS root FROM words UNION ALL SELECT u.word, f.form FROM up u JOIN named f ON u.root = f.word WHERE f.form IS NOT NULL)
SELECT n.word, n.form, u.root, n.n, n.n_near, n.form_n FROM named n JOIN up u USING (word) JOIN named last ON u.root = last.word AND last.form IS NULL
""",
    "op13_hard_negatives": """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
s AS (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.label <> p.own AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5
""",
    "op9_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len({WORDS_SQL.format('text')}), 0)::BIGINT AS size,
                  md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () AS everything,
             coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
v AS (SELECT *, (1.5::DOUBLE * everything - 2.0::DOUBLE * filled) / open_weight AS level FROM l),
t AS (SELECT source, source_size, weight, max(CASE WHEN 2.0::DOUBLE * source_size > level * weight THEN level END) OVER () AS water FROM v),
g AS (SELECT source, source_size, CASE WHEN water IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, water * weight) END AS target FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END) AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * before + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL.format('text')}, []) AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM h) WHERE doc_id > m),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM r),
l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, [x.w FOR x IN list_transform(w, lambda v, i: {{'w': v, 'i': i}}) IF NOT coalesce(list_contains(gone, x.i), FALSE)] AS kept
      FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
}
