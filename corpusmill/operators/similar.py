"""Similarity joins: an inverted index of rare elements, prefix and length filters, then exact comparison of candidates.

Two sets that share at least m of the n elements of one of them share one of its n - m + 1 rarest elements. So each row is listed under
that prefix alone, rarest first within its group, and only rows that meet in a list are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import source
from corpusmill.sources.storage import stored

#: Rows of a list that are compared with each other in one group.
BLOCK = 256
#: Words of 64 marks for each question.
MARKS = 8


def prefixes(rows: DataFrame, keys: list[str], least: Column) -> DataFrame:
    """keys, element: the prefix of each row, whose elements (distinct) are ranked by how many rows of its group have them.

    rows: keys (the group first, together unique), elements array<string>. least: how many elements a row shares at least with a partner.
    """
    return _rarest(rows.select(*keys, F.size("elements").alias("_n"), least.cast("int").alias("_least"), F.explode("elements").alias("element")), keys)


def _rarest(each: DataFrame, keys: list[str]) -> DataFrame:
    """The prefixes of rows that are given by elements: keys, element, _n (elements of the row), _least."""
    often = each.groupBy(keys[0], "element").agg(F.count("*").alias("_often"))
    ranked = each.join(often, [keys[0], "element"]).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_often", "element"))).alias("_all"), F.first("_n").alias("_n"), F.first("_least").alias("_least")
    )
    prefix = F.slice("_all", F.lit(1), F.greatest(F.col("_n") - F.col("_least") + 1, F.lit(0)))
    return ranked.select(*keys, F.explode(F.filter(prefix, lambda e: e["_often"] > 1)["element"]).alias("element"))


def similar_sets(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """grp, a, b, sim: the pairs a < b of a group, from different sides, whose Jaccard similarity reaches the larger floor of the two.

    rows: grp, id, side, elements array<string> (distinct), floor (above 0). Copies are for the caller to collapse (see classes). Rows without elements have no
    partner; rows without group, id or side neither.
    """
    rows = stored(spark, rows.where("grp IS NOT NULL AND id IS NOT NULL AND side IS NOT NULL").select("grp", "id", "side", "elements", F.col("floor").cast("double").alias("floor")), "similar-rows")
    n = F.size("elements")
    listed = prefixes(rows, ["grp", "id"], F.ceil(F.col("floor") * n - 1e-9)).join(rows.select("id", "grp", "side", "floor", n.alias("n")), ["grp", "id"])
    listed = stored(spark, listed, "similar-lists")
    a, b = listed.alias("a"), listed.alias("b")
    floor = F.greatest("a.floor", "b.floor")
    meet = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.side") != F.col("b.side"))
    meet = meet & (F.least("a.n", "b.n") >= floor * F.greatest("a.n", "b.n") - 1e-9)
    tried = a.join(b, meet).select(F.col("a.grp").alias("grp"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), floor.alias("floor")).distinct()
    side = lambda x: rows.select("grp", F.col("id").alias(x), F.col("elements").alias(f"_{x}"))
    both = tried.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    common = F.size(F.array_intersect("_a", "_b"))
    both = both.withColumn("sim", common / (F.size("_a") + F.size("_b") - common))
    return both.where("sim >= floor").select("grp", "a", "b", "sim")


def classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds class, the smallest id of the rows that agree on some columns (elements as sets)."""
    key = F.xxhash64(*by)
    firsts = rows.groupBy(*by).agg(F.min("id").alias("class"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    joined = rows.withColumn("_key", key).alias("r").join(firsts.withColumn("_key", key).alias("f"), [F.col("r._key") == F.col("f._key"), *same])
    return joined.select("r.*", "f.class").drop("_key")


def linked(spark: SparkSession, pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b and the further columns of pairs: every two rows a < b from different sides, one a member of x and the other of y.

    pairs: x, y (two keys once, in either order; a key with itself for the rows within it) and more. members: key, id, side; rows without one of these have no partner.
    Members of a key are cut into blocks of about `block` rows by a hash, and each two blocks meet in a row of their own, so that a large key is dealt out.
    """
    members = members.where("key IS NOT NULL AND id IS NOT NULL AND side IS NOT NULL")
    # few: one row for each `block` rows at most
    large = F.broadcast(members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks")).where("_blocks > 1"))
    place = F.pmod(F.xxhash64("id", "side"), F.coalesce("_blocks", F.lit(1)))
    packed = members.join(large, "key", "left").groupBy("key", place.alias("block")).agg(F.collect_list(F.struct("id", "side")).alias("rows"))
    packed = stored(spark, packed, "member-blocks")
    at = lambda k, *more: packed.select(F.col("key").alias(k), F.col("block").alias(f"_{k}"), *more)
    meet = pairs.join(at("x"), "x").join(at("y"), "y").where("x <> y OR _x <= _y")
    met = meet.join(at("x", F.col("rows").alias("_a")), ["x", "_x"]).join(at("y", F.col("rows").alias("_b")), ["y", "_y"])
    each = met.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    once = F.when(F.expr("x = y AND _x = _y"), F.col("_a.id") < F.col("_b.id")).otherwise(F.col("_a.id") != F.col("_b.id"))
    more = [c for c in pairs.columns if c not in ("x", "y")]
    return each.where((F.col("_a.side") != F.col("_b.side")) & once).select(*more, F.least("_a.id", "_b.id").alias("a"), F.greatest("_a.id", "_b.id").alias("b"))


def roots(spark: SparkSession, up: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root: where the chains of up (node, root; one row a node, no cycles) end. Each round doubles the steps."""
    now = stored(spark, up.select("node", "root"), "roots")
    for _ in range(rounds):
        further = now.select(F.col("node").alias("root"), F.col("root").alias("_further"))
        step = stored(spark, now.join(further, "root", "left").select("node", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        now = step.select("node", "root")
        if step.where("_moved").isEmpty():
            return now
    raise RuntimeError(f"chains did not end in {rounds} rounds")


def _counted(tokens: DataFrame, floor: float) -> DataFrame:
    """intent, pair_id, element, _n, _least for each token of a question; the second "the" is another element than the first."""
    # dealt by question, so that its tokens are counted where they are
    each = tokens.select("intent", "pair_id", "tokens").repartition("intent", "pair_id").select("intent", "pair_id", F.size("tokens").alias("_n"), F.explode("tokens").alias("_token"))
    times = each.groupBy("intent", "pair_id", "_n", "_token").agg(F.count("*").alias("_times"))
    least = F.ceil(floor / (2 - floor) * F.col("_n") - 1e-9).cast("int")
    return times.select("intent", "pair_id", "_n", least.alias("_least"), F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_time"), "_token").select(
        "intent", "pair_id", F.concat_ws("#", "_token", "_time").alias("element"), "_n", "_least"
    )


def _marks(each: DataFrame) -> DataFrame:
    """intent, pair_id, n, m0 to m7: bits that are set where an odd number of a question's elements hash to them.

    Elements of both questions cancel out, so two questions differ in at least as many elements as bits.
    """
    at = F.pmod(F.xxhash64("element"), F.lit(64 * MARKS)).cast("int")
    words = [F.bit_xor(F.when(F.shiftright("_at", 6) == w, F.expr("shiftleft(1L, _at & 63)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(MARKS)]
    return each.select("intent", "pair_id", "_n", at.alias("_at")).groupBy("intent", "pair_id").agg(F.first("_n").alias("n"), *words)


def phrase_clusters(spark: SparkSession, rows: DataFrame, cap: int = 25, floor: float = 0.85, block: int = BLOCK) -> DataFrame:
    """intent, pair_id, question, cluster, kept: at most cap questions of each phrasing cluster of an intent, in md5(pair_id) order.

    rows: intent, pair_id (unique), question (normalised; null is empty). A question joins the cluster of an equal earlier one, else that of the earlier
    one with most common tokens (at least half of its own; ties: the first) whose ROUGE-L F1 exceeds the floor, else it begins one, named
    by its pair_id. Questions that the cap rejects are remembered too: whom a question joins doesn't depend on the cap.

    So each different question has one pointer, to an earlier one or to none, and a cluster is a tree of pointers. An F1 above the floor
    needs over floor / (2 - floor) of a question's tokens in common, which bounds the prefixes that candidates must share. Lists above
    `block` rows are cut into blocks by a hash, and each two blocks meet in one group. Lists hold sizes and marks, not tokens: only pairs whose
    marks leave room for the floor are compared. All of those are tried, however many there are.
    """
    rows = rows.select(F.coalesce("intent", F.lit("")).alias("intent"), F.col("pair_id").cast("string").alias("pair_id"), F.coalesce("question", F.lit("")).alias("question"))
    rows = stored(spark, rows.withColumn("k", F.md5("pair_id")), "questions")
    firsts = rows.groupBy("intent", "question").agg(F.min(F.struct("k", "pair_id")).alias("first")).select("intent", "question", "first.k", "first.pair_id")
    firsts = stored(spark, firsts, "different-questions")
    tokens = firsts.select("intent", "k", "pair_id", F.regexp_extract_all(F.lower("question"), F.lit("([a-z0-9_]+)"), F.lit(1)).alias("tokens"))
    tokens = stored(spark, tokens, "question-tokens")
    each = stored(spark, _counted(tokens, floor), "question-elements")
    listed = _rarest(each, ["intent", "pair_id"]).join(_marks(each), ["intent", "pair_id"]).join(tokens.select("pair_id", "k"), "pair_id")
    listed = stored(spark, listed, "question-lists")
    sizes = listed.groupBy("intent", "element").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    own = listed.join(sizes, ["intent", "element"]).withColumn("block", F.pmod(F.xxhash64("pair_id"), "blocks"))
    other = F.explode(F.expr("filter(sequence(0L, blocks - 1), x -> x <> block OR blocks = 1)"))
    slim = ["k", "pair_id", "block", "n", *(f"m{w}" for w in range(MARKS))]
    meets = own.withColumn("_other", other).select("intent", "element", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), *slim)
    # two blocks meet once; rows of one block meet in a group of their own
    inside = own.where("blocks > 1").select("intent", "element", F.col("block").alias("low"), F.col("block").alias("high"), *slim)
    dealt = meets.union(inside)
    a, b = dealt.alias("a"), dealt.alias("b")
    both = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("intent", "element", "low", "high")]
    earlier = (F.struct("b.k", "b.pair_id") < F.struct("a.k", "a.pair_id")) & ((F.col("a.low") == F.col("a.high")) | (F.col("a.block") != F.col("b.block")))
    n, differ = F.col("a.n") + F.col("b.n"), sum((F.bit_count(F.col(f"a.m{w}").bitwiseXOR(F.col(f"b.m{w}"))) for w in range(MARKS)), F.lit(0))
    room = (2 * F.least("a.n", "b.n") > floor * n - 1e-9) & (differ < (1 - floor) * n + 1e-9)
    tried = a.join(b, [*both, earlier & room]).select(F.col("a.pair_id").alias("pair_id"), F.col("b.pair_id").alias("best_id")).distinct()
    side = lambda x, *more: tokens.select(F.col("pair_id").alias(x), F.col("tokens").alias(f"_{x}"), *more)
    pairs = tried.join(side("pair_id"), "pair_id").join(side("best_id", F.col("k").alias("best_k")), "best_id").withColumn("shared", F.size(F.array_intersect("_pair_id", "_best_id")))
    pairs = pairs.where(2 * F.col("shared") >= F.size(F.array_distinct("_pair_id"))).where(source.rouge_exceeds("_pair_id", "_best_id", F.lit(float(floor))))
    best = pairs.groupBy("pair_id").agg(F.min(F.struct((-F.col("shared")).alias("less"), "best_k", "best_id"))["best_id"].alias("root"))
    placed = roots(spark, best.select(F.col("pair_id").alias("node"), "root"))
    named = firsts.join(placed, firsts["pair_id"] == placed["node"], "left").select("intent", "question", F.coalesce("root", "pair_id").alias("cluster"))
    out = stored(spark, rows.join(named, ["intent", "question"]), "clustered-questions")
    rank = F.row_number().over(Window.partitionBy("intent", "cluster").orderBy("k", "pair_id"))
    last = out.select("intent", "cluster", "k", "pair_id").withColumn("_rank", rank).where(F.col("_rank") <= cap).groupBy("intent", "cluster").agg(F.max(F.struct("k", "pair_id")).alias("_last"))
    return out.join(last, ["intent", "cluster"]).select("intent", "pair_id", "question", "cluster", (F.struct("k", "pair_id") <= F.col("_last")).alias("kept"))
