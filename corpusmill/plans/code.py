"""Source-code queries. Functions are rendered from part rows, so that DuckDB can say from the columns what the parser must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import corpus as O
from corpusmill.operators import source as S
from corpusmill.operators import phrasing, twins

from corpusmill.sources.storage import stored

from .registry import ORACLES, query, table


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """A function for every part; its traits hang on p_size: decorated (3), async (5), documented (4), annotated (2), raising (7)."""
    size = F.col("p_size")
    has = lambda n, text: F.when(size % n == 0, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in text])).otherwise("")
    code = F.concat(
        has(3, ["@cached\n"]), has(5, ["async "]), F.lit("def part_"), F.col("p_partkey"), F.lit("(items, limit"), has(2, [": int"]), F.lit("="), size, F.lit(")"), has(2, [" -> int"]), F.lit(":\n"),
        has(4, ['    """', F.col("p_name"), ' summary line in plain prose."""\n']), F.lit("    if not items:\n"),
        F.when(size % 7 == 0, F.concat(F.lit('        raise ValueError("'), F.col("p_brand"), F.lit('")\n'))).otherwise("        return None\n"),
        F.lit("    total = 0\n    for item in items:\n        total += item\n    return total + limit"),
    )
    # parsing is the cost, and a small table may come as one partition: deal the slim columns out first
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(spark.sparkContext.defaultParallelism)
    part = part.select("p_partkey", "p_name", "p_brand", "p_size", code.alias("code"))
    name = F.concat(F.lit("part_"), F.col("p_partkey"))
    return part.withColumn("qualified", F.concat(F.lit("parts."), name)).withColumn("func_name", name).withColumn("is_method", F.lit(False))


def methods(spark: SparkSession, sf: str) -> DataFrame:
    """A method for every part: a bare (3: 0) or a named (1) except, self (2: 0) or another first name, static (5), exceptions documented rightly (4: 0), wrongly (1), not (2) or without cause (3)."""
    size = F.col("p_size")
    code = F.concat(
        F.when(size % 5 == 0, "@staticmethod\n").otherwise(""), F.lit("def part_"), F.col("p_partkey"), F.when(size % 2 == 0, "(self, x):\n").otherwise("(this, x):\n"),
        F.lit('    """'), F.col("p_name"), F.when(size % 4 == 2, "").otherwise("\n\n    Raises:\n        KeyError: if it isn't there\n    "), F.lit('"""\n'),
        F.when(size % 3 == 0, "    try:\n        x = 1\n    except:\n        x = 2\n").when(size % 3 == 1, "    try:\n        x = 1\n    except OSError:\n        x = 2\n").otherwise(""),
        F.when(size % 4 == 0, "    raise KeyError(x)").when(size % 4 == 1, "    raise ValueError(x)").otherwise("    return x"),
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size").repartition(spark.sparkContext.defaultParallelism).select("p_partkey", code.alias("code"))
    name = F.concat(F.lit("part_"), F.col("p_partkey"))
    return part.select("p_partkey", "code", F.concat(F.lit("Parts."), name).alias("qualified"), F.concat(F.lit("Parts."), name).alias("func_name"), F.lit(True).alias("is_method"))


#: First docstring lines of other functions, for questions with options.
OTHER_DOCS = [f"Another function's first line, number {i}." for i in range(12)]


def facts(spark: SparkSession, sf: str, intent: str) -> DataFrame:
    """(p_partkey, about, answer) of one intent; a lettered answer is shown as its option."""
    rows = methods(spark, sf) if intent in ("G2", "G4", "H2") else rendered(spark, sf)
    found = S.extract_facts(rows, ["p_partkey"], pool=OTHER_DOCS, intents=(intent,))
    value = lambda k: F.get_json_object("seed", f"$.{k}")
    about = F.concat_ws("/", *[value(k) for k in ("param", "feature", "count_of", "callee", "construct", "k", "n", "var", "property", "line", "aspect", "exit_kind")])
    option = F.get(F.from_json(value("options"), "array<string>"), F.ascii("answer") - 65)
    return found.select("p_partkey", about.alias("about"), F.when(F.col("answer_type") == "letter", option).otherwise(F.col("answer")).alias("answer"))


_DEF = "(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END)"
_GUARD = "CASE WHEN p_size % 7 = 0 THEN 'raise' ELSE 'return None' END"
#: intent -> list of (about, answer, condition) in SQL over part
EXPECTED: dict[str, list[tuple[str, str, str]]] = {
    "A1": [("''", "'part_' || p_partkey", "TRUE")], "A2": [("''", "'2'", "TRUE")], "A3": [("''", "'items, limit'", "TRUE")], "A4": [("'limit'", "p_size::VARCHAR", "TRUE")],
    "A5": [("'*args'", "'no'", "TRUE"), ("'**kwargs'", "'no'", "TRUE"), ("'keyword-only params'", "'no'", "TRUE")], "A6": [("''", "'int'", "p_size % 2 = 0")], "A7": [("'limit'", "'int'", "p_size % 2 = 0")],
    "A8": [("''", "'cached'", "p_size % 3 = 0")], "A9": [("''", "CASE WHEN p_size % 5 = 0 THEN 'yes' ELSE 'no' END", "TRUE")], "A10": [("'is_method'", "'no'", "TRUE")],
    "A11": [("'return statements'", "CASE WHEN p_size % 7 = 0 THEN '1' ELSE '2' END", "TRUE"), ("'if statements'", "'1'", "TRUE"), ("'loops'", "'1'", "TRUE"), ("'string literals'", "CASE WHEN p_size % 7 = 0 THEN '1' ELSE '0' END", "TRUE"), ("'calls/ValueError'", "'1'", "p_size % 7 = 0")],
    "A12": [("'1'", "p_brand", "p_size % 7 = 0")],
    "B2": [("'if/1'", "'not items'", "TRUE")], "B3": [("'1'", "'None'", "p_size % 7 <> 0"), ("CASE WHEN p_size % 7 = 0 THEN '1' ELSE '2' END", "'total + limit'", "TRUE")],
    "B4": [("''", "p_name || ' summary line in plain prose.'", "p_size % 4 = 0")], "B5": [("'for-loop body/1'", f"'L' || (6 + {_DEF}) || '-L' || (6 + {_DEF})", "TRUE")],
    "B6": [(f"'{c}'", "'no'", "p_size % 7 <> 0" if c == "raise statement" else "TRUE") for c in ("with statement", "while loop", "try/except", "lambda", "assert statement", "raise statement", "yield", "list comprehension")],
    "C1": [("''", "NULL", "TRUE")], "C2": [("'items'", "NULL", "p_size % 3 = 0 OR p_size % 5 = 0")], "C3": [("''", "NULL", "TRUE")],
    "C4": [("'mutates an argument'", "'no'", "TRUE"), ("'recursive'", "'no'", "TRUE"), ("'can return None'", "CASE WHEN p_size % 7 = 0 THEN 'no' ELSE 'yes' END", "TRUE")],
    "C6": [("''", "'ValueError'", "p_size % 7 = 0")], "C7": [("'item'", "'loop counter'", "TRUE"), ("'total'", "'accumulator'", "TRUE")],
    "E1": [(_GUARD, "'not items'", "TRUE")], "E2": [("''", "'no'", "TRUE")], "E3": [("''", "'None; total + limit'", "p_size % 7 <> 0")], "F1": [("'item'", f"'L' || (5 + {_DEF})", "TRUE")],
    "F2": [("''", "'items, limit'", "TRUE")], "F3": [("''", "'no'", "TRUE")], "F4": [("''", "'none'", "TRUE")], "G1": [("''", "'no'", "TRUE")], "G3": [("''", "'no'", "TRUE")],
    "H1": [("''", "p_name || ' summary line in plain prose.'", "p_size % 4 = 0")], "H3": [("'present'", "CASE WHEN p_size % 4 = 0 THEN 'yes' ELSE 'no' END", "TRUE"), ("'style'", "'plain prose'", "p_size % 4 = 0 AND length(p_name) + 29 > 30")],
    "C5": [("''", "p_name || ' summary line in plain prose.'", "p_size % 4 = 0")], "G2": [("''", "CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'no' END", "p_size % 3 <> 2")],
    "G4": [("''", "CASE WHEN p_size % 2 = 0 THEN 'no' ELSE 'yes' END", "p_size % 5 <> 0")], "H2": [("''", "CASE WHEN p_size % 4 = 0 THEN 'yes' ELSE 'no' END", "p_size % 4 <> 2")],
}


def _register(intent: str) -> None:
    rows = EXPECTED[intent]
    parts = [f"SELECT p_partkey, {about} AS about, ({answer})::VARCHAR AS answer FROM part WHERE {when}" for about, answer, when in rows]
    query(f"fact_{intent}", " UNION ALL ".join(parts))(lambda spark, sf, i=intent: facts(spark, sf, i))


for _intent in [i for i in EXPECTED if i != "B1"]:
    _register(_intent)


@query("fact_B1", "SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest(generate_series(1, 7 + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END)) FROM part) GROUP BY p_partkey")
def fact_b1(spark, sf):
    """Every line from the def on can be asked for."""
    return facts(spark, sf, "B1").groupBy("p_partkey").agg(F.count("*").alias("n"))


CASES = [  # id, code, method, intent, about, answer: hand-made functions for what the rendered ones don't show
    (1, 'def f(a, b=[], *args, c: "int" = 1, **kw):\n    a.append(b)\n    list = 3\n    return list', False, "F4", "", "a"),
    (2, 'def f(a, b=[], *args, c: "int" = 1, **kw):\n    a.append(b)\n    list = 3\n    return list', False, "G1", "", "yes"),
    (3, "def f(x):\n    try:\n        return 1\n    except:\n        pass", False, "G2", "", "yes"),
    (4, "@deco\n    def m(this, x):\n        return x", True, "G4", "", "yes"),
    (5, "@classmethod\n    def m(cls, x):\n        return x", True, "G4", "", "no"),
    (6, 'def f(x):\n    """Doc.\n\n    Raises:\n        KeyError: no\n    """\n    raise KeyError(x)', False, "H2", "", "yes"),
    (7, 'def f(x):\n    """Doc.\n\n    Raises:\n        KeyError: no\n    """\n    raise ValueError', False, "H2", "", "no"),
    (8, "def f(a, b, c):\n    d = a\n    e = d + b\n    g = c\n    return e", False, "F2", "", "a, b"),
    (9, "def f(n):\n    def g():\n        return 1\n    return f(n - 1)", False, "C4", "recursive", "yes"),
    (10, "def f():\n    return 1\n    x = 2", False, "E2", "", "yes"),
    (11, "def f(été, x):\n    y = 'é'\n    return été", False, "F3", "", "yes"),
    (12, "def f(x):\r\n    return f'{x}' + 'lit'\r\n", False, "A12", "1", "lit"),
    (13, "def f(list):\n    return list", False, "G3", "which", "list"),
]


@query("facts_adversarial", "SELECT * FROM (VALUES " + ", ".join("({}::BIGINT, '{}')".format(c[0], c[5]) for c in CASES) + ") t(id, answer)")
def facts_adversarial(spark, sf):
    rows = spark.createDataFrame(CASES, "id long, code string, is_method boolean, want string, about string, answer string")
    rows = rows.select("id", C.newline_normalised("code").alias("code"), F.lit("q").alias("qualified"), F.lit("C.f").alias("func_name"), "is_method", "want", F.col("about").alias("want_about"))
    found = S.extract_facts(rows, ["id", "want", "want_about"]).where("intent = want")
    value = lambda k: F.get_json_object("seed", f"$.{k}")
    about = F.concat_ws("/", value("property"), value("aspect"), value("n"))
    return found.where(about == F.col("want_about")).select("id", "answer")


FILE = "'import os' || chr(10) || chr(10) || 'class Box:' || chr(10) || '    def get_' || p_partkey || '(self, a: int):' || chr(10) || '        return ''é''' || chr(10) || chr(10) || '@deco' || chr(10) || 'async def top_' || p_partkey || '(x):' || chr(10) || '    def inner(): pass' || chr(10) || '    return \"' || p_brand || '\"' || chr(10)"


@query("extract_functions", f"""SELECT p_partkey, 'Box.get_' || p_partkey AS name, TRUE AS is_method, FALSE AS is_async, FALSE AS decorated, TRUE AS typed, 1 AS n_strings FROM part
UNION ALL SELECT p_partkey, 'top_' || p_partkey, FALSE, TRUE, TRUE, FALSE, 1 FROM part""")
def extract_functions(spark, sf):
    return S.extract_functions(files(spark, sf), ["p_partkey"]).select("p_partkey", "name", "is_method", "is_async", "decorated", "typed", "n_strings")


def files(spark: SparkSession, sf: str) -> DataFrame:
    k, nl = F.col("p_partkey").cast("string"), "\r\n"
    content = F.concat(F.lit(f"import os{nl}{nl}class Box:{nl}    def get_"), k, F.lit(f"(self, a: int):{nl}        return 'é'{nl}{nl}@deco{nl}async def top_"), k, F.lit(f"(x):{nl}    def inner(): pass{nl}    return \""), F.col("p_brand"), F.lit(f"\"{nl}"))
    # as in rendered: parsing is the cost, so the slim columns are dealt out first
    part = table(spark, sf, "part").select("p_partkey", "p_brand").repartition(spark.sparkContext.defaultParallelism)
    return part.select("p_partkey", "p_brand", content.alias("content"))


@query("function_spans", "SELECT p_partkey, 'Box.get_' || p_partkey AS name, TRUE AS ok FROM part UNION ALL SELECT p_partkey, 'top_' || p_partkey, TRUE FROM part")
def function_spans(spark, sf):
    """Byte spans cut the normalised file to exactly the code, multi-byte text before or not."""
    found = S.extract_functions(files(spark, sf), ["p_partkey", "content"])
    raw = F.encode(C.newline_normalised("content"), "UTF-8")
    cut = F.decode(raw.substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return found.select("p_partkey", "name", (F.trim(cut) == F.col("code")).alias("ok"))


@query("stub_flag", "SELECT p_partkey, p_size % 4 < 3 AS stub FROM part")
def stub_flag(spark, sf):
    body = F.when(F.col("p_size") % 4 == 0, "pass").when(F.col("p_size") % 4 == 1, "...").when(F.col("p_size") % 4 == 2, "raise NotImplementedError('x')").otherwise("return 1")
    code = F.concat(F.lit('def f():\n    """Doc."""\n    '), body)
    return table(spark, sf, "part").select("p_partkey", S.is_stub(code).alias("stub"))


@query("skeleton_family", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size % 2 = 0, p_size % 3 = 0, p_size % 5 = 0, p_size % 7 = 0) AS first_of_family FROM part")
def skeleton_family(spark, sf):
    """Names, numbers, strings and docstrings don't count: functions share a family exactly if they share the traits that do."""
    rows = rendered(spark, sf).select("p_partkey", S.family("code").alias("fam"))
    rows = stored(spark, rows, "skeletons")
    return rows.join(rows.groupBy("fam").agg(F.min("p_partkey").alias("first_of_family")), "fam").select("p_partkey", "first_of_family")


@query("style_features", "SELECT p_partkey, p_size % 5 = 0 AS is_async, p_size % 3 = 0 AS decorated, p_size % 4 = 0 AS has_docstring, p_size % 2 = 0 AS typed FROM part")
def style_features(spark, sf):
    found = S.extract_functions(rendered(spark, sf).withColumnRenamed("code", "content"), ["p_partkey"])
    return found.select("p_partkey", "is_async", "decorated", "has_docstring", "typed")


def generations(spark: SparkSession, sf: str) -> DataFrame:
    k, code = F.col("p_partkey") % 6, F.col("code")
    gen = (
        F.when(k == 0, code).when(k == 1, F.concat(code, F.lit("\n\nnext = 1"))).when(k == 2, F.regexp_replace(code, "    total = 0\n", "    total = 0  # start\n\n"))
        .when(k == 3, F.regexp_replace(code, "total = 0", "total = 1")).when(k == 4, F.concat(code, F.lit(" +"))).otherwise(F.lit("def ("))
    )
    return rendered(spark, sf).select("p_partkey", "p_size", code.alias("reference"), gen.alias("gen"))


@query("verdict_ladder", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'BYTE' WHEN 1 THEN 'BYTE' WHEN 2 THEN 'CODE' ELSE 'MISS' END AS verdict FROM part")
def verdict_ladder(spark, sf):
    return generations(spark, sf).select("p_partkey", S.verdict("reference", "gen").alias("verdict"))


@query("code_exact", "SELECT p_partkey, p_partkey % 6 < 3 AS ok FROM part")
def code_exact(spark, sf):
    return generations(spark, sf).select("p_partkey", S.code_exact("reference", "gen").alias("ok"))


@query("span_segments", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS docstrings, (2 + CASE WHEN p_size % 4 = 0 THEN 0 ELSE 0 END - CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END)::INT AS literals FROM part""")
def span_segments(spark, sf):
    """Spans cover the text; a default inside the signature isn't a literal of its own."""
    code = rendered(spark, sf)
    spans = S.segments(code.withColumn("total", F.length("code")), ["p_partkey", "total"])
    checked = spans.groupBy("p_partkey", "total").agg(F.count_if(F.col("kind") == "docstring").cast("int").alias("docstrings"), F.count_if(F.col("kind") == "literal").cast("int").alias("literals"), F.sum(F.col("end") - F.col("start")).alias("covered"))
    return checked.where("covered = total").select("p_partkey", "docstrings", "literals")


@query("token_classes", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS docstrings, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS strings, 0 AS unknown FROM part")
def token_classes(spark, sf):
    found = S.char_classes(rendered(spark, sf), ["p_partkey"])
    n = lambda c: F.count_if(F.col("cls") == c).cast("int")
    return found.groupBy("p_partkey").agg(n("docstring").alias("docstrings"), n("string").alias("strings"), n("unk").alias("unknown"))


@query("function_facts", "SELECT p_partkey, 'part_' || p_partkey AS name, ['items', 'limit'] AS params, CASE WHEN p_size % 7 = 0 THEN ['ValueError'] ELSE [] END AS calls FROM part")
def function_facts(spark, sf):
    rows = rendered(spark, sf).select("p_partkey", S.function_facts("code").alias("f"))
    return rows.select("p_partkey", "f.name", "f.params", "f.calls")


@query("content_tokens", "SELECT p_partkey, 'F' AS own, p_size::VARCHAR AS fallback FROM part WHERE p_size % 3 <> 0")
def content_tokens(spark, sf):
    rows = rendered(spark, sf).where("p_size % 3 <> 0").select("p_partkey", "p_size", S.content_tokens("code", "func_name").alias("t"))
    return rows.select("p_partkey", F.get("t", F.lit(0)).alias("own"), F.element_at(F.filter("t", lambda x: x.rlike("^[0-9]+$")), 1).alias("fallback"))


#: Intents that methods show; the rendered functions show the others.
OF_METHODS = ("G2", "G4", "H2")
_COUNTED = " UNION ALL ".join(f"SELECT '{i}' AS intent, p_partkey FROM ({ORACLES[f'fact_{i}']})" for i in EXPECTED if i != "B1")
_COUNTED += f" UNION ALL SELECT 'B1', p_partkey FROM (SELECT p_partkey, unnest(range(n)) FROM ({ORACLES['fact_B1']}))"


@query("coverage_counters", f"""SELECT intent, count(*) AS emitted, count(DISTINCT p_partkey) AS applicable FROM ({_COUNTED}) GROUP BY intent""")
def coverage_counters(spark, sf):
    """Facts, and functions with any, per intent over all functions, for all intents that anything shows."""
    others = ("B1", *(i for i in EXPECTED if i not in OF_METHODS))
    found = S.coverage(rendered(spark, sf), ["p_partkey"], OTHER_DOCS, others).union(S.coverage(methods(spark, sf), ["p_partkey"], OTHER_DOCS, OF_METHODS))
    return found.where("emitted > 0").select("intent", "emitted", "applicable")


@query("reject_reasons", """SELECT 'rejected' AS event, 'parse' AS reason, count(*) AS n FROM part WHERE p_size % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 'screened', CASE WHEN p_size % 11 = 0 THEN 'parse' WHEN p_size % 5 = 0 THEN 'async' WHEN p_size % 3 = 0 THEN 'decorated' ELSE 'pass' END AS reason, count(*) FROM part GROUP BY reason""")
def reject_reasons(spark, sf):
    """Why functions are rejected, and why they may not run; one in eleven is made unparseable."""
    rows = rendered(spark, sf).withColumn("code", F.when(F.col("p_size") % 11 == 0, F.concat("code", F.lit("("))).otherwise(F.col("code")))
    return S.reject_reasons(rows, ["p_partkey"], OTHER_DOCS)


#: Intents whose one slot is what their oracle calls about.
_SLOTS = {"A1": "", "A2": "", "A3": "", "A4": "param", "A5": "feature", "A9": "", "C4": "property", "F1": "var", "B6": "construct"}
_ASKED = " UNION ALL ".join(f"SELECT p_partkey, '{i}' AS intent, about, replace('{phrasing.CARDS[i]}', '{{{slot}}}', about) AS clause FROM ({ORACLES[f'fact_{i}']})" for i, slot in _SLOTS.items())
_SPOKEN = " ".join(f"WHEN {k} THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, t in enumerate(phrasing.STYLES.values()))


@query("fact_prompts", f"""WITH asked AS ({_ASKED}) SELECT p_partkey, intent, about, replace(CASE ('0x' || substr(md5(p_partkey || '|' || intent || '|' || about), 1, 8))::BIGINT % {len(phrasing.STYLES)} {_SPOKEN} END, '{{x}}', clause) AS prompt FROM asked""")
def fact_prompts(spark, sf):
    """A prompt for every fact of some intents; test_phrasing has all intents."""
    found = S.extract_facts(rendered(spark, sf), ["p_partkey"], pool=OTHER_DOCS, intents=tuple(_SLOTS))
    about = F.concat_ws("", *[F.get_json_object("seed", f"$.{slot}") for slot in dict.fromkeys(_SLOTS.values()) if slot])
    asked = phrasing.phrased(found.withColumn("about", about), F.concat_ws("|", "p_partkey", "intent", "about"))
    return asked.select("p_partkey", "intent", "about", "prompt")


def stacked(spark: SparkSession, sf: str) -> DataFrame:
    rows = rendered(spark, sf)
    stacks = O.stacks(spark, rows.select(F.col("p_partkey").alias("id"), F.col("func_name").alias("name")))
    members = stacks.join(rows.withColumnRenamed("p_partkey", "id"), "id").groupBy("stack").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "qualified", "func_name", "code", "is_method"))).alias("m"))
    members = members.select("stack", F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["qualified"].alias("qualified"), x["func_name"].alias("func_name"), x["code"].alias("code"), x["is_method"].alias("is_method"))).alias("members"))
    return O.cyclic_next(spark, members.withColumn("own", F.col("members")[0]["func_name"]), "own", "stack", "decoy").drop("own")


@query("stack_facts")
def stack_facts(spark, sf):
    """I1 to I5 over stacks of eight, with a decoy from the next stack."""
    return S.extract_stack_facts(stacked(spark, sf))


@query("multi_match")
def multi_match(spark, sf):
    """I6: two genuine twins in a stack, answered by both names sorted; fillers of other families, from a hash order."""
    rows = rendered(spark, sf).where("p_partkey <= 300").select(F.col("p_partkey").alias("id"), F.col("func_name").alias("name"), F.concat(F.lit("r"), F.col("p_partkey") % 9).alias("repo"), S.family("code").alias("fam"), S.content_tokens("code", "func_name").alias("toks"))
    side = lambda x: rows.select(F.col("id").alias(x), F.col("toks").alias(f"t{x}"), F.col("name").alias(f"n{x}"))
    pairs = O.same_family_pairs(rows).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.withColumn("sim", S.similarity(F.array_join("ta", " "), F.array_join("tb", " "))).where(F.col("sim") >= C.similarity_floor(F.least(F.size("ta"), F.size("tb"))))
    chosen = O.disjoint_pairs(pairs.select("fam", "a", "b", "sim"), 4)
    named = chosen.join(side("a").drop("ta"), "a").join(side("b").drop("tb"), "b")
    # fillers: for each family the first six functions of other families; one bounded list serves them all
    pool = rows.groupBy("fam").agg(F.min_by("id", F.md5(F.col("id").cast("string"))).alias("id")).agg(F.array_sort(F.collect_list(F.struct("fam", "id"))).alias("pool"))
    out = named.join(pool, F.lit(True)).withColumn("fillers", F.slice(F.filter("pool", lambda x: x["fam"] != F.col("fam")), 1, 6))
    return out.select("fam", "a", "b", F.array_join(F.array_sort(F.array("na", "nb")), ", ").alias("answer"), F.transform("fillers", lambda x: x["id"]).alias("fillers"))


@query("multi_match_violations", "SELECT 0::BIGINT AS question, '' AS problem WHERE FALSE")
def multi_match_violations(spark, sf):
    """The verifier over the questions of multi_match: all are sound. multi_match_rules shows that each rule can fire."""
    rows = rendered(spark, sf).select(F.col("p_partkey").alias("id"), "code", F.col("func_name").alias("name"), F.concat(F.lit("r"), F.col("p_partkey") % 9).alias("repo"), S.family("code").alias("fam"))
    asked = stored(spark, multi_match(spark, sf), "asked").select(F.col("a").cast("long").alias("question"), "a", "b", F.concat(F.array("a", "b"), "fillers").alias("stack"), F.col("a").alias("described"), F.col("a").alias("target"), "answer", F.array("fam").alias("told"))
    return twins.problems(asked, rows)


TWIN = "def {}(items, limit):\n    total = 0\n    for item in items:\n        if item > limit:\n            total += item * {}\n    return total"
#: id, name, repository, code, and whose family it is filed under (none: its own).
TWINS = [
    (1, "alpha", "r1", TWIN.format("alpha", 2), None), (2, "beta", "r2", TWIN.format("beta", 3), None), (3, "gamma", "r1", TWIN.format("gamma", 3), None), (4, "ALPHA", "r4", TWIN.format("ALPHA", 3), None),
    (5, "delta", "r5", TWIN.format("delta", 3).replace("total = 0", "total = -1"), 1), (6, "eps", "r6", TWIN.format("eps", 3), 11),
    (7, "zeta", "r7", "def zeta(rows, bound):\n    count = 9\n    for row in rows:\n        if row > bound:\n            count += row * 7\n    return count", None),
    *[(10 + k, f"fill{k}", f"r{k}", f"def fill{k}(x):\n" + "    x = x + 1\n" * k + "    return x", None) for k in range(1, 8)], (18, "other", "r8", "def other(x):\n    x = x + 1\n    return x", None), (19, "FILL1", "r9", "def FILL1(x):\n    while x:\n        x = x - 1\n    return x", None),
]
_FILL = [11, 12, 13, 14, 15, 16]
#: question, a, b, fillers, described, target, answer, told, and the rules it breaks.
ASKED = [
    (0, 1, 2, _FILL, 1, 1, "alpha, beta", "doubles", []), (1, 1, 2, [*_FILL[1:], 99], 1, 1, "alpha, beta", "doubles", ["unknown member"]), (2, 1, 5, _FILL, 1, 1, "alpha, delta", "doubles", ["shapes differ"]),
    (3, 1, 6, _FILL[1:], 1, 1, "alpha, eps", "doubles", ["families differ"]), (4, 1, 7, _FILL, 7, 7, "alpha, zeta", "doubles", ["too little alike"]), (5, 1, 4, _FILL, 1, 1, "ALPHA, alpha", "doubles", ["names agree", "stack names agree"]),
    (6, 1, 3, _FILL, 1, 1, "alpha, gamma", "doubles", ["one repository"]), (7, 1, 2, _FILL, 1, 1, "beta, alpha", "doubles", ["answer"]), (8, 1, 2, _FILL, 11, 11, "alpha, beta", "doubles", ["described"]), (9, 1, 2, _FILL, 1, 2, "alpha, beta", "doubles", ["described"]),
    (10, 1, 2, [*_FILL[1:], 3], 1, 1, "alpha, beta", "doubles", ["filler is a match"]), (11, 1, 2, [*_FILL[:5], 18], 1, 1, "alpha, beta", "doubles", ["fillers agree"]), (12, 1, 2, [*_FILL[:5], 19], 1, 1, "alpha, beta", "doubles", ["stack names agree"]),
    (13, 1, 2, _FILL, 1, 1, "alpha, beta", "what alpha does", ["name is told"]),
]


@query("multi_match_rules", "SELECT * FROM (VALUES " + ", ".join(f"({q[0]}::BIGINT, '{rule}')" for q in ASKED for rule in q[-1]) + ") t(question, problem)")
def multi_match_rules(spark, sf):
    """The verifier over a sound question and damaged ones, at least one for each of its rules."""
    functions = spark.createDataFrame(TWINS, "id long, name string, repo string, code string, as_ long").withColumn("shape", S.family("code"))
    filed = functions.select(F.col("id").alias("as_"), F.col("shape").alias("filed"))
    functions = functions.join(filed, "as_", "left").withColumn("fam", F.coalesce("filed", "shape"))
    asked = spark.createDataFrame([q[:-1] for q in ASKED], "question long, a long, b long, fillers array<long>, described long, target long, answer string, told string")
    return twins.problems(asked.withColumn("stack", F.concat(F.array("a", "b"), "fillers")).withColumn("told", F.array("told")), functions)


RUNNABLE = "def calc_{k}(n: int, items: list):\n    total = {s}\n    for i in items:\n        total = total + n\n    if n > 2:\n        return total\n    return [total]"


@query("exec_facts", """WITH p AS (SELECT p_partkey, p_size FROM part WHERE p_partkey <= 40), c AS (SELECT * FROM p, (VALUES (0, 1, '[5]'), (3, 2, '[''a'', ''b'']'), (7, 3, '[1, 2, 3]')) v(n, len, items))
SELECT p_partkey, 'D1' AS intent, n || ';' || items AS input, CASE WHEN n > 2 THEN (p_size + n * len)::VARCHAR ELSE '[' || (p_size + n * len) || ']' END AS answer FROM c
UNION ALL SELECT p_partkey, 'D6', n || ';' || items, len::VARCHAR FROM c UNION ALL SELECT p_partkey, 'D5', n || ';' || items, CASE WHEN n > 2 THEN 'yes' ELSE 'no' END FROM c
UNION ALL SELECT p_partkey, 'C2x', '0;[]', '[' || p_size || ']' FROM p""")
def exec_facts(spark, sf):
    """Outputs, branches and loop counts of sandboxed runs against the closed form of the template."""
    part = table(spark, sf, "part").where("p_partkey <= 40")
    head, tail = RUNNABLE.split("{k}")
    mid, end = tail.split("{s}")
    rows = part.select("p_partkey", F.concat(F.lit(head), F.col("p_partkey"), F.lit(mid), F.col("p_size"), F.lit(end)).alias("code"))
    found = S.run_functions(rows, ["p_partkey"]).where(F.col("intent").isin("D1", "D5", "D6", "C2x"))
    args = F.from_json(F.get_json_object("seed", "$.args"), "array<string>")
    return found.select("p_partkey", "intent", F.concat_ws(";", args).alias("input"), "answer")


SCREENED = [("async def f():\n    return 1", "async"), ("@d\ndef f():\n    return 1", "decorated"), ("def f():\n    yield 1", "generator"), ("def f():\n    global x\n    x = 1", "global"), ("def f():\n    import os", "import"),
            ("def f(a):\n    return a.__class__", "dunder"), ("def f():\n    return cfg.x", "attr_on_global"), ("def f():\n    return open('x')", "forbidden"), ("def f():\n    return other", "free_var"), ("def f(g):\n    return g(1)", "param_called"), ("def f(self):\n    return 1", "self"), ("def (", "parse")]


@query("exec_screen", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{r}')" for i, (_, r) in enumerate(SCREENED)) + ") t(id, reason)")
def exec_screen(spark, sf):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(SCREENED)], "id long, code string")
    return S.run_functions(rows, ["id"]).select("id", "reason")


@query("parse_screened_sample", "SELECT p_partkey FROM part WHERE p_size % 7 = 0")
def parse_screened_sample(spark, sf):
    """Parse-screened sample: only texts that parse stay."""
    rows = rendered(spark, sf).withColumn("code", F.when(F.col("p_size") % 7 == 0, F.col("code")).otherwise(F.concat("code", F.lit("("))))
    return rows.where(S.parses("code")).select("p_partkey")


