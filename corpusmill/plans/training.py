"""Trainer data-plane queries: rarity, masses, weighted losses, telemetry folds, pooling; and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import training as T
from corpusmill.sources.storage import stored

from .registry import query, table

TOKENS = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS token FROM documents)"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("token"))


@query("rarity_table", f"""WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), m AS (SELECT max(n) AS hi, min(n) AS lo, sum(n) AS total FROM c)
SELECT token, n, floor((ln(hi) - ln(n)) / greatest(ln(hi) - ln(lo), 1e-12) * 1e6 + 0.5) / 1e6 AS rarity, n < 0.0001 * total AS is_rare FROM c, m""")
def rarity_table(spark, sf):
    out = T.rarity(tokens(spark, sf), rare_below=1e-4)
    return out.withColumn("rarity", F.floor(F.col("rarity") * 1e6 + 0.5) / 1e6)


@query("topfrac_rare", f"""WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), p AS (SELECT doc_id, unnest(list_zip(generate_series(1, len(l)), l)) AS x FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z]+)', 1) AS l FROM documents)),
r AS (SELECT doc_id, x[1] AS pos, x[2] AS token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n, x[1] DESC) AS rn, count(*) OVER (PARTITION BY doc_id) AS total FROM p JOIN c ON c.token = x[2])
SELECT doc_id, pos::INT AS pos, token FROM r WHERE rn <= floor(total * 0.1)""")
def topfrac_rare(spark, sf):
    """The rarest tenth of each text's tokens, ties to the later one."""
    counts = stored(spark, tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n")), "counts")
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    again = stored(spark, docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    if again.isEmpty():
        return T.rarest(spark, docs, counts)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    several = docs.join(again, same, "left_semi").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))).alias("pos", "token"))
    w = Window.partitionBy("doc_id")
    ranked = several.withColumn("pos", F.col("pos") + 1).join(counts, "token").withColumn("rn", F.row_number().over(w.orderBy("n", F.desc("pos")))).withColumn("total", F.count("*").over(w))
    return T.rarest(spark, docs.join(again, same, "left_anti"), counts).union(ranked.where(F.col("rn") <= F.floor(F.col("total") * 0.1)).select("doc_id", "pos", "token"))


@query("identifier_order", r"SELECT doc_id, count_if(rn = 1)::BIGINT AS first_seen, count_if(rn > 1)::BIGINT AS repeated FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, token ORDER BY 1) AS rn FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS token FROM documents)) GROUP BY doc_id")
def identifier_order(spark, sf):
    """First and repeated occurrences of a token within its text."""
    per = tokens(spark, sf).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.count("*").alias("first_seen"), F.sum(F.col("n") - 1).alias("repeated"))


@query("surprisal_lookup", "SELECT l.doc_id IS NOT NULL AS hit, count(*) AS n FROM documents d LEFT JOIN labels l ON md5(d.doc_id::VARCHAR) = md5(l.doc_id::VARCHAR) GROUP BY hit")
def surprisal_lookup(spark, sf):
    """Left join by digest, with hits and misses counted."""
    known = table(spark, sf, "labels").select(F.md5(F.col("doc_id").cast("string")).alias("k"), F.lit(True).alias("hit"))
    rows = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("k"))
    return rows.join(known, "k", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))


SPANS = """s AS (SELECT doc_id, unnest([{'k': 'head', 'a': 0, 'b': n_chars // 3}, {'k': 'mid', 'a': n_chars // 3, 'b': 2 * n_chars // 3}, {'k': 'tail', 'a': 2 * n_chars // 3, 'b': n_chars}]) AS x FROM documents),
t AS (SELECT doc_id, unnest(generate_series(0, n_chars // 50)) AS i FROM documents)"""


def spans_and_tokens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    third = lambda k: F.floor(F.col("n_chars") * k / 3).cast("long")
    spans = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), third(i).alias("start"), third(i + 1).alias("end")) for i, n in enumerate(("head", "mid", "tail"))])).alias("x")).select("doc_id", "x.*")
    toks = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 50))).alias("i")).select("doc_id", (F.col("i") * 50).alias("a"), (F.col("i") * 50 + 50).alias("b"), (F.col("i") % 7 + 1).alias("mass"))
    return spans, toks


@query("span_masses", f"WITH {SPANS} SELECT s.doc_id, x.k AS kind, sum(i % 7 + 1)::BIGINT AS mass FROM s JOIN t ON s.doc_id = t.doc_id AND i * 50 < x.b AND i * 50 + 50 > x.a GROUP BY ALL")
def span_masses(spark, sf):
    """Mass of the tokens that overlap each span: an equi-join on the text with the overlap as a residual."""
    spans, toks = spans_and_tokens(spark, sf)
    return T.span_masses(spans, toks).select("doc_id", "kind", "mass")


@query("span_drift", f"WITH {SPANS}, m AS (SELECT s.doc_id, x.k AS kind, sum(i % 7 + 1)::BIGINT AS mass FROM s JOIN t ON s.doc_id = t.doc_id AND i * 50 < x.b AND i * 50 + 50 > x.a GROUP BY ALL) SELECT kind, sum(mass)::BIGINT AS total, count(*) AS n, sum(mass) / count(*) AS mean FROM m GROUP BY kind")
def span_drift(spark, sf):
    m = T.span_masses(*spans_and_tokens(spark, sf))
    return m.groupBy("kind").agg(F.sum("mass").alias("total"), F.count("*").alias("n"), (F.sum("mass") / F.count("*")).alias("mean"))


@query("prose_weighted_loss", """SELECT event_type, sum(c * w)::BIGINT AS weighted, sum(w)::BIGINT AS weights, sum(c * w) / greatest(sum(w), 1) AS loss FROM (SELECT event_type, floor(value * 100)::BIGINT AS c,
 CASE WHEN event_type = 'click' THEN 1 WHEN event_id % 10 = 0 THEN 8 WHEN value < 10 THEN 4 ELSE 2 END AS w FROM events) GROUP BY event_type""")
def prose_weighted_loss(spark, sf):
    """Weighted mean with the precedence prose, rare, margin, plain."""
    rows = table(spark, sf, "events").withColumn("c", F.floor(F.col("value") * 100))
    w = T.loss_weight(prose=F.col("event_type") == "click", rare=F.col("event_id") % 10 == 0, margin=F.col("value") < 10)
    agg = rows.withColumn("w", w).groupBy("event_type").agg(F.sum(F.col("c") * F.col("w")).alias("weighted"), F.sum("w").cast("long").alias("weights"))
    return agg.withColumn("loss", F.col("weighted") / F.greatest("weights", F.lit(1)))


@query("class_probe", "SELECT event_type, count(*) AS n, count_if(value < 20)::BIGINT AS act, count_if(value < 5)::BIGINT AS wrong, floor(sum(floor(value * 100)) / count(*) + 0.5) / 100 AS margin FROM events GROUP BY event_type")
def class_probe(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v < 20).alias("act"), F.count_if(v < 5).alias("wrong"), (F.floor(F.sum(F.floor(v * 100)) / F.count("*") + 0.5) / 100).alias("margin"))


@query("capture_ratio", "SELECT (f - v) / greatest(f - c, 1e-6) AS capture FROM (SELECT sum(CASE WHEN event_type = 'view' THEN floor(value) END) / count_if(event_type = 'view') AS f, sum(CASE WHEN event_type = 'click' THEN floor(value) END) / count_if(event_type = 'click') AS v, sum(CASE WHEN event_type = 'error' THEN floor(value) END) / count_if(event_type = 'error') AS c FROM events)")
def capture_ratio(spark, sf):
    mean = lambda k: F.sum(F.when(F.col("event_type") == k, F.floor("value").cast("double"))) / F.count_if(F.col("event_type") == k)
    means = table(spark, sf, "events").agg(mean("view").alias("f"), mean("click").alias("v"), mean("error").alias("c"))
    return means.select(((F.col("f") - F.col("v")) / F.greatest(F.col("f") - F.col("c"), F.lit(1e-6))).alias("capture"))


@query("telemetry_trim", "SELECT event_id FROM events WHERE event_id % 17 <> 0 AND (event_id % 5 = 0 OR event_id <= 600)")
def telemetry_trim(spark, sf):
    """Torn JSON lines and steps after the resume point go; lines without a step stay."""
    torn = F.when(F.col("event_id") % 17 == 0, F.lit('{"step": ')).when(F.col("event_id") % 5 == 0, F.lit('{"note": 1}')).otherwise(F.concat(F.lit('{"step": '), F.col("event_id"), F.lit("}")))
    return T.telemetry_trim(table(spark, sf, "events").select("event_id", torn.alias("value")), 600).select("event_id")


@query("ema_fold", """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, value AS ema FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, 0.98 * f.ema + 0.02 * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, floor(ema * 1e6 + 0.5) / 1e6 AS ema FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS k FROM f) WHERE k = 1""")
def ema_fold(spark, sf):
    rows = table(spark, sf, "events")
    return T.ema(rows, "user_id", "value", ["ts", "event_id"], 0.98).select("user_id", (F.floor(F.col("ema") * 1e6 + 0.5) / 1e6).alias("ema"))


@query("worker_reduce", """SELECT step, sum(c)::BIGINT AS total, count(*) AS workers, max(c) - min(c) AS spread, count(e)::BIGINT AS with_ema FROM (SELECT event_id // 8 AS step, floor(value * 100)::BIGINT AS c, CASE WHEN event_id % 3 = 0 THEN value END AS e FROM events) GROUP BY step""")
def worker_reduce(spark, sf):
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 8).alias("step"), F.floor(F.col("value") * 100).alias("c"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("e"))
    return rows.groupBy("step").agg(F.sum("c").alias("total"), F.count("*").alias("workers"), (F.max("c") - F.min("c")).alias("spread"), F.count("e").alias("with_ema"))


@query("hist_map", "SELECT user_id, list_sort(list(event_type || ':' || n)) AS hist FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def hist_map(spark, sf):
    """Histogram as a map, shown as sorted entries."""
    maps = T.histogram(table(spark, sf, "events"), "user_id", "event_type")
    return maps.select("user_id", F.sort_array(F.transform(F.map_entries("hist"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))).alias("hist"))


@query("hard_pool", """SELECT event_id FROM events WHERE value >= 50 ORDER BY md5('hard|' || event_id), event_id LIMIT 64""")
def hard_pool(spark, sf):
    """Swap-in of hard examples: those above the bar in hash order."""
    return table(spark, sf, "events").where("value >= 50").select("event_id").orderBy(C.hash_order("hard", "event_id"), "event_id").limit(64)


@query("anneal_schedule", "SELECT s AS step, floor(0.5 * (1 + cos(pi() * s / 100)) * 1e9 + 0.5) / 1e9 AS scale FROM (SELECT unnest(generate_series(0, 100)) AS s)")
def anneal_schedule(spark, sf):
    return spark.range(101).select(F.col("id").alias("step"), (F.floor(0.5 * (1 + F.cos(F.pi() * F.col("id") / 100)) * 1e9 + 0.5) / 1e9).alias("scale"))


ROUND = "floor(({}) * 1e4 + 0.5) / 1e4"


@query("pool_mean_pf4", f"SELECT vec_id, g::INT AS g, {ROUND.format('m')} AS m FROM (SELECT vec_id, g, list_sum(list_slice(embedding, g * 4 + 1, g * 4 + 4)::DOUBLE[]) / 4 AS m FROM (SELECT vec_id, embedding, unnest(generate_series(0, 15)) AS g FROM embeddings))")
def pool_mean_pf4(spark, sf):
    """Mean of each four neighbours."""
    pooled = table(spark, sf, "embeddings").select("vec_id", F.posexplode(T.pool_mean(F.col("embedding"), 4)).alias("g", "m"))
    return pooled.withColumn("m", F.floor(F.col("m") * 1e4 + 0.5) / 1e4)


@query("phase_rotate", f"SELECT vec_id, i::INT AS i, {ROUND.format('embedding[2 * i + 1]::DOUBLE * cos(i / 8.0) - embedding[2 * i + 2]::DOUBLE * sin(i / 8.0)')} AS x FROM (SELECT vec_id, embedding, unnest(generate_series(0, 31)) AS i FROM embeddings)")
def phase_rotate(spark, sf):
    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(T.rotate(F.col("embedding"), 32, 8.0)).alias("i", "x"))
    return out.withColumn("x", F.floor(F.col("x") * 1e4 + 0.5) / 1e4)


@query("softmax_pool", f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS w, embedding FROM embeddings) SELECT vec_id, {ROUND.format('list_sum(list_transform(list_zip(w, embedding), lambda p: p[1] * p[2]::DOUBLE)) / list_sum(w)')} AS pooled FROM e")
def softmax_pool(spark, sf):
    pooled = T.softmax_pool(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", (F.floor(pooled * 1e4 + 0.5) / 1e4).alias("pooled"))
