"""Question and evaluation queries over conversations, labels and documents, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import corpus as O
from corpusmill.operators import evaluation as E
from corpusmill.operators import similar

from .registry import query, table

PAIRS = """pairs AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 WHERE role = 'user' AND next_role = 'assistant')"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return turns.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("qa_pairs_from_turns", f"WITH {PAIRS} SELECT conv_id, turn, md5(question) AS q, md5(answer) AS a FROM pairs")
def qa_pairs_from_turns(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query("context_attach", """WITH s AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n, list_aggregate(list_transform(turns, lambda t: t::VARCHAR), 'string_agg', ',') AS turns FROM s WHERE n >= 2""")
def context_attach(spark, sf):
    """Members attached by key in order; a context with a missing member is dropped."""
    turns = table(spark, sf, "conversations")
    wanted = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("idxs"))
    members = wanted.select("conv_id", F.size("idxs").alias("want"), F.posexplode("idxs").alias("pos", "turn")).join(turns, ["conv_id", "turn"])
    packed = members.groupBy("conv_id", "want").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "text"))).alias("m"))
    whole = packed.where((F.size("m") == F.col("want")) & (F.col("want") >= 2))
    return whole.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["turn"].cast("string")), ",").alias("turns"))


@query("question_repair", r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS repaired FROM conversations""")
def question_repair(spark, sf):
    """Every question dressed in a think block, a prefix and quotes, then repaired."""
    dressed = F.concat(F.lit("<think>hm\n</think> `Question: \""), "text", F.lit('"`'))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(C.question_repair(dressed)).alias("repaired"))


@query("format_reject", """SELECT role, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 8 THEN 'too_short' WHEN length(t) > 500 THEN 'too_long' WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'no_letters' WHEN contains(t, '```') THEN 'code_fence'
 WHEN regexp_matches(t, '(?i)fact card|ground.truth|style directive|as an ai|i cannot|the answer is') THEN 'meta_reference' END AS reason, count(*) AS n FROM (SELECT role, left(text, 3 + length(text) % 600) AS t FROM conversations) GROUP BY ALL""")
def format_reject(spark, sf):
    t = F.col("text").substr(F.lit(1), (3 + F.length("text") % 600).cast("int"))
    return table(spark, sf, "conversations").groupBy("role", C.format_reject(t).alias("reason")).agg(F.count("*").alias("n"))


NORM = r"trim(regexp_replace(lower(translate({}, '‘’“”' || chr(39), repeat(chr(34), 5))), '\s+', ' ', 'g'))"


@query("answer_leak", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, {NORM.format('question')} AS q, {NORM.format("split_part(answer, ' ', 1)")} AS n FROM pairs), u AS (SELECT *, trim(trim(n, chr(34))) AS term FROM t)
SELECT conv_id, turn, CASE WHEN term = '' OR n IN ('none', 'then', 'else', 'true', 'false') THEN FALSE WHEN regexp_matches(term, '^-?[0-9]+(?:\.[0-9]+)?$') THEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_.])' || regexp_escape(term) || '($|[^\p{{L}}\p{{N}}_.])')
 WHEN regexp_matches(term, '^[\p{{L}}\p{{N}}_]+$') THEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(term) || '($|[^\p{{L}}\p{{N}}_])')
 WHEN length(term) >= 3 THEN contains(q, term) ELSE NOT regexp_matches(term, '[\p{{L}}\p{{N}}_]') AND regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(term) || '($|[^\p{{L}}\p{{N}}_])') END AS leaks FROM u""")
def answer_leak(spark, sf):
    """Whether a question shows the first word of its answer."""
    rows = pairs(spark, sf).withColumn("term", F.split_part("answer", F.lit(" "), F.lit(1)))
    terms = C.leak_terms(F.col("term"), F.lit("substring"), F.array().cast("array<string>"))
    return rows.select("conv_id", "turn", C.leaks(F.col("question"), terms).alias("leaks"))


@query("text_norm", r"SELECT conv_id, turn, md5(trim(regexp_replace(lower(translate(text, '‘’“”' || chr(39), repeat(chr(34), 5))), '\s+', ' ', 'g'))) AS n FROM conversations")
def text_norm(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(C.text_norm("text")).alias("n"))


@query("exact_phrase_cap", r"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY md5(conv_id || '-' || turn)) AS rn FROM conversations) WHERE rn <= 3")
def exact_phrase_cap(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).alias("q"), F.md5(F.concat_ws("-", "conv_id", "turn")).alias("k"))
    return O.capped(rows, "q", 3, ["k"]).select("conv_id", "turn")


@query("phrase_clusters")
def phrase_clusters(spark, sf):
    """The near-duplicate cap with its memory of rejected questions."""
    rows = table(spark, sf, "conversations").select(F.col("role").alias("intent"), F.concat_ws("-", "conv_id", "turn").alias("pair_id"), C.text_norm("text").alias("question"))
    return similar.phrase_clusters(spark, rows, 5)


@query("rouge_l_pairs", f"""WITH RECURSIVE {PAIRS}, t AS (SELECT conv_id, turn, regexp_extract_all(lower(question), '([a-z0-9_]+)', 1) AS a, regexp_extract_all(lower(answer), '([a-z0-9_]+)', 1) AS b FROM pairs),
f AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(generate_series(0, len(b)), lambda x: 0) AS row FROM t
 UNION ALL SELECT conv_id, turn, a, b, i + 1, list_reduce(list_transform(generate_series(1, len(b)), lambda j: [CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE row[j + 1] END, (b[j] = a[i + 1])::INT]),
  lambda acc, x: list_append(acc, CASE WHEN x[2] = 1 THEN x[1] ELSE greatest(x[1], acc[-1]) END), [0]) FROM f WHERE i < len(a) AND len(b) > 0)
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 OR row[-1] = 0 THEN 0.0 ELSE 2.0 * row[-1] / (len(a) + len(b)) END AS f1 FROM f WHERE i = len(a) OR len(b) = 0""")
def rouge_l_pairs(spark, sf):
    """Longest common subsequence of whole questions and answers."""
    from corpusmill.operators import source as S

    return pairs(spark, sf).select("conv_id", "turn", S.rouge_l(C.rouge_tokens("question"), C.rouge_tokens("answer")).alias("f1"))


@query("mock_judge", "SELECT conv_id, turn, (('0x' || substr(h, 1, 8))::BIGINT * 79228162514264337593543950336 % 100 + ('0x' || substr(h, 9, 8))::BIGINT * 18446744073709551616 % 100 + ('0x' || substr(h, 17, 8))::BIGINT * 4294967296 % 100 + ('0x' || substr(h, 25, 8))::BIGINT % 100) % 100 < 95 AS ok FROM (SELECT conv_id, turn, md5('judge|' || conv_id || '-' || turn) AS h FROM conversations)".replace("* 79228162514264337593543950336 % 100", "% 100 * 36 % 100").replace("* 18446744073709551616 % 100", "% 100 * 16 % 100").replace("* 4294967296 % 100", "% 100 * 96 % 100"))
def mock_judge(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", C.judge_passes(F.concat_ws("-", "conv_id", "turn")).alias("ok"))


@query("seed_and_pair_id", "SELECT conv_id, turn, ('0x' || substr(md5(conv_id || '.' || turn), 1, 12))::BIGINT AS seed, substr(md5('A1|' || turn || '|' || conv_id), 1, 16) AS pair_id FROM conversations")
def seed_and_pair_id(spark, sf):
    key = F.concat_ws(".", "conv_id", "turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", C.seed_of(key).alias("seed"), F.substring(F.md5(F.concat_ws("|", F.lit("A1"), "turn", "conv_id")), 1, 16).alias("pair_id"))


@query("prediction_extract", r"""SELECT conv_id, turn, left(regexp_replace(split_part(t, chr(10), 1), '^\s+|\s+$', '', 'g'), 200) AS first_line, left(regexp_replace(left(t, least(CASE WHEN strpos(t, chr(10)) > 0 THEN strpos(t, chr(10)) ELSE 1000000 END, CASE WHEN strpos(t, 'Q:') > 0 THEN strpos(t, 'Q:') ELSE 1000000 END, CASE WHEN strpos(t, 'A:') > 0 THEN strpos(t, 'A:') ELSE 1000000 END) - 1), '^\s+|\s+$', '', 'g'), 200) AS corrected
FROM (SELECT conv_id, turn, text || ' Q: more' || chr(10) || 'tail' AS t FROM conversations)""")
def prediction_extract(spark, sf):
    raw = F.concat("text", F.lit(" Q: more\ntail"))
    return table(spark, sf, "conversations").select("conv_id", "turn", C.first_line(raw).alias("first_line"), C.corrected(raw).alias("corrected"))


@query("qa_prompt", r"""SELECT conv_id, turn, 'Q: ' || left(text, 40) || CASE WHEN turn % 2 = 0 THEN chr(10) || 'A) yes' || chr(10) || 'B) no' ELSE '' END || chr(10) || 'A:' AS prompt FROM conversations""")
def qa_prompt(spark, sf):
    options = F.when(F.col("turn") % 2 == 0, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", C.options_prompt(F.left("text", F.lit(40)), options).alias("prompt"))


@query("ordinals", "SELECT doc_id, doc_id || CASE WHEN doc_id % 100 BETWEEN 10 AND 20 THEN 'th' WHEN doc_id % 10 = 1 THEN 'st' WHEN doc_id % 10 = 2 THEN 'nd' WHEN doc_id % 10 = 3 THEN 'rd' ELSE 'th' END AS nth FROM documents")
def ordinals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.ordinal("doc_id").alias("nth"))


CASES = [  # id, pred, gold, kind, intent, siblings, what the grade must be
    (1, "Yes, it is.", "yes", "yesno", "A9", [], True), (2, "No", "yes", "yesno", "A9", [], False), (3, "the answer is B", "B", "letter", "C7", [], True), (4, "A cat", "B", "letter", "C7", [], False),
    (5, "about 3.0 of them", "3", "number", "A2", [], True), (6, "four", "4", "number", "A2", [], False), (7, "lines 3 to 7", "L3-L7", "line_ref", "B5", [], True), (8, "L7-L3", "L3-L7", "line_ref", "B5", [], False),
    (9, "alpha and beta", "alpha, beta", "name", "I6", ["gamma"], True), (10, "beta, alpha", "alpha, beta", "name", "I6", ["gamma"], True), (11, "alpha", "alpha, beta", "name", "I6", [], False),
    (12, "alpha, beta and gamma", "alpha, beta", "name", "I6", ["gamma"], False), (13, "Add, add", "Add, add", "name", "I6", [], False), (14, "a, b", "a, b", "name", "A3", [], True), (15, "b, a", "a, b", "name", "A3", [], False),
    (16, "it calls add_numbers", "add", "name", "A1", [], False), (17, "`add`", "add", "name", "A1", ["sub"], True), (18, "add or sub", "add", "name", "A1", ["sub"], False), (19, "x", "", "substring", "B4", [], False),
    (20, "<think>no</think>“Hello”  world", '"hello" world', "substring", "B4", [], True), (21, "prefix the text suffix", "the text", "substring", "B4", [], True), (22, None, "yes", "yesno", "A9", [], False),
]


@query("typed_grader", "SELECT * FROM (VALUES " + ", ".join(f"({c[0]}::BIGINT, {str(c[-1]).upper()})" for c in CASES) + ") t(id, ok)")
def typed_grader(spark, sf):
    rows = spark.createDataFrame(CASES, "id long, pred string, gold string, kind string, intent string, siblings array<string>, want boolean")
    return rows.select("id", C.graded(*[F.col(c) for c in ("pred", "gold", "kind", "intent", "siblings")]).alias("ok"))


@query("grade_own_answers", f"WITH {PAIRS} SELECT count(*) AS n, count(*) AS ok FROM pairs WHERE length(trim(answer)) > 0")
def grade_own_answers(spark, sf):
    """A well-formed gold answers itself."""
    rows = pairs(spark, sf).where(F.length(F.trim("answer")) > 0)
    ok = C.graded(F.col("answer"), F.col("answer"), F.lit("substring"), F.lit("B4"), F.array().cast("array<string>"))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))


RECORDS = """records AS (SELECT conv_id * 100 + turn AS row_idx, CASE turn % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'F2' WHEN 2 THEN 'D7' ELSE 'B1' END AS intent, turn % 3 = 1 AS held_out, question, CASE WHEN conv_id % 11 = 0 THEN '' ELSE left(answer, 60) END AS answer,
 CASE WHEN conv_id % 7 = 0 THEN 'letter' ELSE 'substring' END AS answer_type, conv_id % 13 <> 0 AS known_source FROM pairs)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    return pairs(spark, sf).select(
        (F.col("conv_id") * 100 + t).alias("row_idx"), F.when(t % 4 == 0, "A1").when(t % 4 == 1, "F2").when(t % 4 == 2, "D7").otherwise("B1").alias("intent"), (t % 3 == 1).alias("held_out"), "question",
        F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.left("answer", F.lit(60))).alias("answer"), F.when(F.col("conv_id") % 7 == 0, "letter").otherwise("substring").alias("answer_type"),
        F.when(F.col("conv_id") % 13 != 0, "ast").otherwise("web").alias("source"), F.lit(None).cast("array<string>").alias("options"),
    )


@query("contract_validate", f"""WITH {PAIRS}, {RECORDS}, v AS (SELECT unnest(list_filter([CASE WHEN trim(answer) = '' THEN 'blank answer' END, CASE WHEN trim(question) = '' THEN 'blank question' END, CASE WHEN held_out <> (intent IN ('F2', 'D7')) THEN 'held-out flag' END,
 CASE WHEN answer_type = 'letter' AND NOT regexp_matches(trim(answer), '^[A-D]$') THEN 'letter answer' END, CASE WHEN answer_type = 'letter' THEN 'letter without options' END, CASE WHEN NOT known_source THEN 'unknown source' END], lambda x: x IS NOT NULL)) AS violation FROM records)
SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def contract_validate(spark, sf):
    return records(spark, sf).select(F.explode(E.violations()).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("stage_drop_matrix", rf"""WITH {PAIRS}, {RECORDS}, t AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN row_idx % 9 = 0 THEN question || ' ' || answer WHEN row_idx % 17 = 0 THEN left(question, 5) ELSE question END, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM records),
 u AS (SELECT *, {NORM.format('t')} AS q, {NORM.format('answer')} AS n FROM t), v AS (SELECT *, trim(trim(n, chr(34))) AS term FROM u), d AS (SELECT intent, CASE
 WHEN length(t) = 0 THEN 'format:empty' WHEN length(t) < 8 THEN 'format:too_short' WHEN length(t) > 500 THEN 'format:too_long' WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'format:no_letters' WHEN contains(t, '```') THEN 'format:code_fence'
 WHEN regexp_matches(t, '(?i)fact card|ground.truth|style directive|as an ai|i cannot|the answer is') THEN 'format:meta_reference' WHEN answer_type <> 'letter' AND length(term) >= 3 AND contains(q, term) THEN 'leak'
 WHEN trim(answer) = '' THEN 'contract:blank answer' WHEN held_out <> (intent IN ('F2', 'D7')) THEN 'contract:held-out flag' WHEN answer_type = 'letter' THEN 'contract:letter answer' WHEN NOT known_source THEN 'contract:unknown source' ELSE 'kept' END AS reason FROM v)
SELECT intent, split_part(reason, ':', 1) AS stage, reason, count(*) AS n FROM d GROUP BY intent, reason""")
def stage_drop_matrix(spark, sf):
    """Drops by intent, stage and reason; every ninth question shows its answer, every seventeenth is cut short."""
    worse = F.when(F.col("row_idx") % 9 == 0, F.concat_ws(" ", "question", "answer")).when(F.col("row_idx") % 17 == 0, F.left("question", F.lit(5))).otherwise(F.col("question"))
    reason = F.coalesce(E.drop_reason(), F.lit("kept"))
    counted = records(spark, sf).withColumn("question", worse).groupBy("intent", reason.alias("reason")).agg(F.count("*").alias("n"))
    return counted.select("intent", F.split_part("reason", F.lit(":"), F.lit(1)).alias("stage"), "reason", "n")


ROUND_TRIPS = "held AS (SELECT row_idx, intent, intent IN ('F2', 'D7') AS held_out, intent NOT IN ('F2', 'D7') AND row_idx % 5 = 0 AS stacked, CASE row_idx % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS rt FROM records WHERE trim(answer) <> '' AND trim(question) <> '' AND answer_type <> 'letter' AND known_source)"


@query("heldout_select", f"""WITH {PAIRS}, {RECORDS}, {ROUND_TRIPS} SELECT row_idx, CASE WHEN rt THEN 'heldout' ELSE 'advisory' END AS arm FROM held WHERE held_out
UNION ALL SELECT row_idx, 'trained' FROM (SELECT row_idx FROM held WHERE NOT held_out AND NOT stacked AND rt ORDER BY md5('trained|0|' || row_idx) LIMIT 50)""")
def heldout_select(spark, sf):
    """Pairs and their metadata in torn-checked shards; arms of the evaluation by contract and round trip, with 50 trained pairs."""
    held = F.col("intent").isin(*E.HELD_OUT)
    context = F.when(~held & (F.col("row_idx") % 5 == 0), "stack").otherwise("solo")
    rows = records(spark, sf).withColumn("held_out", held).withColumn("context", context).withColumn("line", F.row_number().over(Window.partitionBy("intent").orderBy("row_idx")))
    meta = rows.select("intent", "line", F.when(F.col("row_idx") % 3 == 0, True).when(F.col("row_idx") % 3 == 1, False).alias("rt"))
    return E.heldout_arms(O.aligned(rows, meta, ["intent", "line"]), 50).select("row_idx", "arm")


@query("pool_partition", f"""WITH {PAIRS}, {RECORDS} SELECT CASE WHEN held_out THEN 'heldout' WHEN intent LIKE 'I%' THEN 'retr' WHEN row_idx % 5 = 0 THEN 'stack' WHEN intent LIKE 'B%' AND answer_type = 'substring' THEN 'span' ELSE 'solo' END AS pool, count(*) AS n FROM records GROUP BY pool""")
def pool_partition(spark, sf):
    rows = records(spark, sf).withColumn("stacked", F.col("row_idx") % 5 == 0)
    return rows.groupBy(E.pool(conceptual=0.0).alias("pool")).agg(F.count("*").alias("n"))


@query("leak_tripwire", f"WITH {PAIRS}, {RECORDS} SELECT row_idx FROM records WHERE held_out AND row_idx % 7 = 0")
def leak_tripwire(spark, sf):
    """Held-out rows in a trained pool. The partition has none, so every seventh row is misplaced here, and those must be found."""
    rows = records(spark, sf).withColumn("stacked", F.col("row_idx") % 5 == 0)
    rows = rows.withColumn("pool", F.when(F.col("row_idx") % 7 == 0, "solo").otherwise(E.pool(conceptual=0.0)))
    return rows.where(F.col("held_out") & (F.col("pool") != "heldout")).select("row_idx")


@query("pool_choice", "SELECT CASE WHEN u < 0.25 THEN 'conceptual' WHEN u < 0.7 THEN 'solo' ELSE 'stack' END AS pool, count(*) AS n FROM (SELECT ('0x' || substr(md5('pool|' || event_id), 1, 12))::BIGINT / 281474976710656.0 AS u FROM events) GROUP BY pool")
def pool_choice(spark, sf):
    u = C.uniform("pool", "event_id")
    return table(spark, sf, "events").groupBy(F.when(u < 0.25, "conceptual").when(u < 0.7, "solo").otherwise("stack").alias("pool")).agg(F.count("*").alias("n"))


@query("stack_draw", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('st|' || conv_id || '|' || turn), turn) AS rn, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE rn <= greatest(1, 4000 // total)")
def stack_draw(spark, sf):
    """Of each stack as many samples as its size allows, at least one."""
    rows = table(spark, sf, "conversations").withColumn("total", F.sum(F.length("text")).over(Window.partitionBy("conv_id"))).drop("text")
    w = Window.partitionBy("conv_id").orderBy(C.hash_order("st", "conv_id", "turn"), "turn")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.lit(4000) / F.col("total")))).select("conv_id", "turn")


@query("distractor_prefix", "SELECT conv_id, turn, list_slice(list_concat(regexp_extract_all(text, '[0-9A-Za-z_]+'), list_transform(generate_series(1, 16), lambda x: '<fill>')), 1, 16) AS prefix FROM conversations")
def distractor_prefix(spark, sf):
    tokens = F.regexp_extract_all("text", F.lit("([0-9A-Za-z_]+)"), F.lit(1))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.slice(F.concat(tokens, F.array_repeat(F.lit("<fill>"), 16)), 1, 16).alias("prefix"))


@query("answer_type_source", "SELECT role, CASE role WHEN 'user' THEN 'substring' WHEN 'assistant' THEN 'text' ELSE 'yesno' END AS answer_type, count(*) AS n FROM conversations GROUP BY role")
def answer_type_source(spark, sf):
    return table(spark, sf, "conversations").groupBy("role", E.narrowed(F.when(F.col("role") == "user", "line_ref_text").when(F.col("role") == "assistant", "text").otherwise("yesno")).alias("answer_type")).agg(F.count("*").alias("n"))


@query("message_builder", r"SELECT conv_id, turn, '```' || chr(10) || left(text, 20) || chr(10) || '```' || chr(10) || 'Fact: ' || role || chr(10) || 'Answer: ' || turn || chr(10) || 'Style: s' || (turn % 3) AS message FROM conversations")
def message_builder(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", E.message(F.left("text", F.lit(20)), None, F.col("role"), None, F.col("turn").cast("string"), F.concat(F.lit("s"), F.col("turn") % 3)).alias("message"))


@query("template_fill", "SELECT conv_id, turn, CASE ('0x' || substr(md5('style|' || conv_id || '|' || turn), 1, 12))::BIGINT % 3 WHEN 0 THEN 'What does ' || role || ' say?' WHEN 1 THEN 'Name ' || role || '.' ELSE 'Tell me:  (' || turn || ')' END AS question FROM conversations")
def template_fill(spark, sf):
    """A style picked by hash, its fields filled; a missing field is empty."""
    fields = {"name": F.col("role"), "turn": F.col("turn").cast("string"), "missing": F.lit(None).cast("string")}
    pick = F.conv(F.substring(C.hash_order("style", "conv_id", "turn"), 1, 12), 16, 10).cast("long") % 3
    templates = ["What does {name} say?", "Name {name}.", "Tell me: {missing} ({turn})"]
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get(F.array(*[E.filled(t, fields) for t in templates]), pick.cast("int")).alias("question"))


# --- receipts and statistics -------------------------------------------------------------------------------------------

RECEIPTS = """receipts AS (SELECT doc_id, source, lang, n_chars, text AS reference, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'more' WHEN 2 THEN text || 'x' ELSE 'y' || text END AS gen FROM documents)"""


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    ref, k = F.col("text"), F.col("doc_id") % 4
    gen = F.when(k == 0, ref).when(k == 1, F.concat(ref, F.lit("\nmore"))).when(k == 2, F.concat(ref, F.lit("x"))).otherwise(F.concat(F.lit("y"), ref))
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", ref.alias("reference"), gen.alias("gen"))


@query("byte_exact", rf"WITH {RECEIPTS} SELECT doc_id % 4 AS kind, count(*) AS n, count_if(starts_with(gen, reference) AND (length(gen) = length(reference) OR substr(gen, length(reference) + 1, 1) = chr(10) OR right(reference, 1) = chr(10)))::BIGINT AS exact FROM receipts GROUP BY kind")
def byte_exact(spark, sf):
    return receipts(spark, sf).groupBy((F.col("doc_id") % 4).alias("kind")).agg(F.count("*").alias("n"), F.count_if(C.byte_exact("reference", "gen")).alias("exact"))


@query("receipt_dedupe", f"WITH {RECEIPTS} SELECT source, reference IS NULL AS blank, count(*) AS n FROM (SELECT source, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE reference END AS reference, row_number() OVER (PARTITION BY source, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE reference END ORDER BY doc_id) AS rn FROM receipts) WHERE rn = 1 OR reference IS NULL GROUP BY ALL")
def receipt_dedupe(spark, sf):
    """The first of each (identity, reference); without a reference nothing is a duplicate."""
    rows = receipts(spark, sf).withColumn("reference", F.when(F.col("doc_id") % 9 != 0, F.col("reference")))
    kept = E.receipt_dedupe(rows, "source", "reference", "doc_id")
    return kept.groupBy("source", F.col("reference").isNull().alias("blank")).agg(F.count("*").alias("n"))


@query("receipt_attach", f"WITH {RECEIPTS} SELECT doc_id, md5(reference) AS h FROM receipts WHERE doc_id % 2 = 0")
def receipt_attach(spark, sf):
    """References attached by position if the lengths agree, else by unique identity; ambiguity fails."""
    rows = receipts(spark, sf)
    some = rows.where("doc_id % 2 = 0").select("doc_id", "gen")
    return E.attach(some, rows.select("doc_id", "reference"), "doc_id").select("doc_id", F.md5("reference").alias("h"))


@query("adjacent_duplicate", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, lead(event_type) OVER (ORDER BY event_id) AS nx, event_type FROM events) WHERE NOT (rn = 1 AND nx = event_type)")
def adjacent_duplicate(spark, sf):
    """Only a first row that repeats as the second goes."""
    head = table(spark, sf, "events").select("event_id", "event_type").orderBy("event_id").limit(2)
    twice = head.agg(F.count_distinct("event_type").alias("k"), F.count("*").alias("n"), F.min("event_id").alias("first")).where("k = 1 AND n = 2").select(F.col("first").alias("event_id"))
    return table(spark, sf, "events").select("event_id").join(twice, "event_id", "left_anti")


WILSON = "(k / n + 1.9208 / n {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n)"


@query("wilson_by_slice", f"SELECT lang, n, k, floor({WILSON.format(s='-')} * 1e6 + 0.5) / 1e6 AS lo, floor({WILSON.format(s='+')} * 1e6 + 0.5) / 1e6 AS hi FROM (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def wilson_by_slice(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    lo, hi = C.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "n", "k", (F.floor(lo * 1e6 + 0.5) / 1e6).alias("lo"), (F.floor(hi * 1e6 + 0.5) / 1e6).alias("hi"))


@query("length_slices", """SELECT label, count(*) AS n, count_if(quality = 1)::BIGINT AS good FROM (SELECT quality, unnest(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN n_chars >= 300 AND n_chars < 3000 THEN 'mid' END, CASE WHEN n_chars >= 3000 AND n_chars <= 600000 THEN 'long' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN NULLIF(toxic, 1) = 0 THEN 'not toxic' END, 'all'], lambda x: x IS NOT NULL)) AS label FROM documents JOIN labels USING (doc_id)) GROUP BY label""")
def length_slices(spark, sf):
    """Slices overlap: a row counts under every label whose predicate is true (null isn't)."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    labels = E.slice_labels({"short": n < 300, "mid": (n >= 300) & (n < 3000), "long": n.between(3000, 600_000), "toxic": F.col("toxic") == 1, "not toxic": F.nullif("toxic", F.lit(1)) == 0, "all": F.lit(True)})
    return rows.select("quality", F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


@query("mcnemar_labels", """WITH RECURSIVE c AS (SELECT count_if(quality = 1 AND toxic = 1)::BIGINT AS "both", count_if(quality = 1 AND toxic = 0)::BIGINT AS left_only, count_if(quality = 0 AND toxic = 1)::BIGINT AS right_only, count_if(quality = 0 AND toxic = 0)::BIGINT AS neither FROM labels),
t AS (SELECT left_only + right_only AS n, least(left_only, right_only) AS m FROM c), b AS (SELECT 0::BIGINT AS i, pow(0.5, n) AS p FROM t UNION ALL SELECT i + 1, p * (n - i) / (i + 1) FROM b, t WHERE i < m)
SELECT "both", left_only, right_only, neither, floor(least(1.0, 2 * (SELECT sum(p) FROM b)) * 1e9 + 0.5) / 1e9 AS p FROM c""")
def mcnemar_labels(spark, sf):
    flags = table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return E.mcnemar(flags).withColumn("p", F.floor(F.col("p") * 1e9 + 0.5) / 1e9)


@query("accuracy_by_intent", f"""WITH {PAIRS}, {RECORDS}, g AS (SELECT intent, row_idx % 2 AS arm, length(answer) % 3 = 0 AS ok, answer = '' AS empty FROM records)
SELECT intent, count_if(arm = 0)::BIGINT AS n_left, count_if(arm = 1)::BIGINT AS n_right, count_if(arm = 0 AND ok)::BIGINT AS ok_left, count_if(arm = 1 AND ok)::BIGINT AS ok_right, count_if(empty)::BIGINT AS empty FROM g GROUP BY intent""")
def accuracy_by_intent(spark, sf):
    g = records(spark, sf).select("intent", F.when(F.col("row_idx") % 2 == 0, "left").otherwise("right").alias("arm"), (F.length("answer") % 3 == 0).alias("ok"), (F.col("answer") == "").alias("empty"))
    by = lambda arm, c=None: F.count_if((F.col("arm") == arm) & (F.col(c) if c else F.lit(True)))
    return g.groupBy("intent").agg(by("left").alias("n_left"), by("right").alias("n_right"), by("left", "ok").alias("ok_left"), by("right", "ok").alias("ok_right"), F.count_if("empty").alias("empty"))


@query("paired_arms", "SELECT quality = 1 AS a, toxic = 1 AS b, count(*) AS n FROM labels GROUP BY ALL")
def paired_arms(spark, sf):
    """Two receipts joined by index, every row with its partner."""
    labels = table(spark, sf, "labels")
    both = O.aligned(labels.select("doc_id", (F.col("quality") == 1).alias("a")), labels.select("doc_id", (F.col("toxic") == 1).alias("b")), ["doc_id"])
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("rescore_totals", f"WITH {RECEIPTS} SELECT count(*) AS n, count_if(gen = reference)::BIGINT AS same, list_sort(list(DISTINCT lang)) AS langs FROM receipts")
def rescore_totals(spark, sf):
    return receipts(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("gen") == F.col("reference")).alias("same"), F.sort_array(F.collect_set("lang")).alias("langs"))


@query("worst_examples", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn <= 3")
def worst_examples(spark, sf):
    return O.first_per_group(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"], 3).select("source", "doc_id")


@query("token_accuracy", f"WITH {RECEIPTS}, t AS (SELECT doc_id, list_slice(string_split(reference, ' '), 1, 30) AS a, list_slice(string_split(gen, ' '), 1, 30) AS b FROM receipts) SELECT doc_id, len(list_filter(generate_series(1, len(a)), lambda i: a[i] = b[i])) / len(a) AS acc FROM t")
def token_accuracy(spark, sf):
    cut = lambda c: F.slice(F.split(c, " "), 1, 30)
    return receipts(spark, sf).select("doc_id", C.token_accuracy(cut("reference"), cut("gen")).alias("acc"))


@query("question_accounting", f"WITH {PAIRS}, k AS (SELECT conv_id, count(*) AS n FROM pairs GROUP BY conv_id) SELECT least(n, 3) AS per_row, count(*) AS rows FROM k GROUP BY per_row")
def question_accounting(spark, sf):
    k = pairs(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"))
    return k.groupBy(F.least("n", F.lit(3)).cast("long").alias("per_row")).agg(F.count("*").alias("rows"))


@query("line_vote")
def line_vote(spark, sf):
    """Per line of a text the vote of its samples after alignment."""
    from corpusmill.operators import source as S

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("rn", F.row_number().over(w)).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("text").alias("t")))), lambda x: x["t"]).alias("samples"))
    return S.line_votes(rows, ["conv_id"], "samples")


@query("side_by_side")
def side_by_side(spark, sf):
    from corpusmill.operators import source as S

    return S.line_diff(receipts(spark, sf), ["doc_id"], "reference", "gen")


@query("sequence_similarity")
def sequence_similarity(spark, sf):
    """Whole texts against edited ones: words replaced, halves in the other order, letters in lower case, a letter more at the end."""
    from corpusmill.operators import source as S

    text, k = F.col("text"), F.col("doc_id") % 4
    half = F.floor(F.length(text) / 2).cast("int")
    turned = F.concat(F.substring(text, half + 1, F.length(text)), F.substring(text, F.lit(1), half))
    edited = F.when(k == 0, F.regexp_replace(text, r"( |\n)t[a-z]+", "$1that")).when(k == 1, turned).when(k == 2, F.lower(text)).otherwise(F.concat(text, F.lit("x")))
    return table(spark, sf, "documents").select("doc_id", S.similarity(text, edited).alias("sim"))
