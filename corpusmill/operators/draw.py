"""The capped draw of validation and train rows, exactly as one sequential pass would make it, by rounds of local decisions.

Phases, in this order: validation from reserved repositories (first pile excepted); all rows of the first pile; then the bands of the other piles,
low to high. Within a phase rows come in the order of a seeded hash. A row is taken unless a counter is full: of its
band (for its split; the first pile counts but isn't held to it), of its repository, of its family if that is boilerplate (and one a
repository), of stubs (for its split). Counters of repositories and families run on from phase to phase, and advance only for rows that are taken.

Whether a row is taken depends on the rows before it that share a counter. Each round bounds every counter from below, by the rows before that are
known to be taken, and from above, by those not known to be refused. A row whose upper bounds all lie below the caps is taken; one with a lower
bound at a cap is refused. Bounds are sums of windows over (counter, stretch of the order) and of the stretches before, so a counter
that all rows share isn't one task. A round settles at least the first open row, mostly nearly all. Once at most `few` rows are open, one task
settles those in order, starting from the counts that the settled rows before each of them have given: the same result, and bounded.

Null repo, fam and band count as values of their own (a null band has no target and isn't drawn); null flags are false; repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.storage import stored

from .corpus import global_rank

FEW, STRETCH = 100_000, 50_000
#: Why a row is refused, by the first counter that is full; a full band is told by the split.
REASONS = ("", "cap_repo", "cap_family", "cap_family", "cap_stub")
_NONE = (1 << 62) - 1
_COUNTERS = "array<struct<kind:int,key:string,cap:long>>"


def _target(of: dict[int, int]):
    out = F.lit(0)
    for band, n in of.items():
        out = F.when(F.col("band") == band, n).otherwise(out)
    return out.cast("long")


def _counters(targets: dict[int, int], val_targets: dict[int, int], repo_cap: int, family_cap: int, stub_caps: tuple[int, int]):
    """The counters of a row, in the order in which they are asked."""
    text = lambda *parts: F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])
    one = lambda kind, key, cap: F.struct(F.lit(kind).alias("kind"), key.alias("key"), cap.cast("long").alias("cap"))
    split, val = F.col("split"), F.col("split") == "validation"
    aim = F.when(val, _target(val_targets)).when(F.col("phase") == 1, _NONE).otherwise(_target(targets))
    always = [one(0, text(split, F.col("band")), aim), one(1, text(F.col("repo")), F.lit(repo_cap))]
    family = [one(2, text(F.col("fam")), F.lit(family_cap)), one(3, text(F.col("fam"), F.col("repo")), F.lit(1))]
    stub = [one(4, split, F.when(val, stub_caps[0]).otherwise(stub_caps[1]))]
    some = lambda flag, which: F.when(F.col(flag), F.array(*which)).otherwise(F.array().cast(_COUNTERS))
    return F.concat(F.array(*always), some("boilerplate", family), some("stub", stub))


def _full(split: str, kind: int) -> str:
    return REASONS[kind] or ("reserved" if split == "validation" else "not_drawn")


def _settled(open_: DataFrame) -> DataFrame:
    """phase, k, id, status of the open rows (with counters and, for each, how many settled rows before it were taken), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[tuple[int, str], int] = {}
        for batch in batches:
            labels = []
            for split, counters, before in zip(*(batch.column(c).to_pylist() for c in ("split", "counters", "before"))):
                keys = [(c["kind"], c["key"]) for c in counters]
                full = next((c["kind"] for c, key, n in zip(counters, keys, before) if n + more.get(key, 0) >= c["cap"]), None)
                if full is None:
                    for key in keys:
                        more[key] = more.get(key, 0) + 1
                labels.append(split if full is None else _full(split, full))
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(labels, pa.string())], ["at", "status"])

    columns = ["at", "split", "counters", "before"]
    return open_.repartition(1).sortWithinPartitions("phase", "k", "at").select(*columns).mapInArrow(run, "at long, status string")


def _bounds(rows: DataFrame) -> DataFrame:
    """at, bounds (kind, cap, taken, not refused before; in the order of the counters) of the open rows."""
    each = rows.select("at", "stretch", "taken", F.col("status").isNull().alias("open"), F.explode("counters").alias("c")).select("*", F.col("c.kind").alias("kind"), F.col("c.key").alias("key"), F.col("c.cap").alias("cap"))
    yes, maybe = F.coalesce(F.col("taken"), F.lit(False)).cast("long"), F.coalesce(F.col("taken"), F.lit(True)).cast("long")
    counter = ["kind", "key"]
    sums = each.groupBy(*counter, "stretch").agg(F.sum(yes).alias("yes"), F.sum(maybe).alias("maybe"))
    earlier = Window.partitionBy(*counter).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*counter, "stretch", F.coalesce(F.sum("yes").over(earlier), F.lit(0)).alias("yes_before"), F.coalesce(F.sum("maybe").over(earlier), F.lit(0)).alias("maybe_before"))
    within = Window.partitionBy(*counter, "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("yes", F.coalesce(F.sum(yes).over(within), F.lit(0))).withColumn("maybe", F.coalesce(F.sum(maybe).over(within), F.lit(0))).where("open")
    both = placed.join(sums, [*counter, "stretch"])
    one = F.struct("kind", "cap", (F.col("yes") + F.col("yes_before")).alias("low"), (F.col("maybe") + F.col("maybe_before")).alias("high"))
    return both.groupBy("at").agg(F.array_sort(F.collect_list(one)).alias("bounds"))


def draw(
    spark: SparkSession, rows: DataFrame, targets: dict[int, int], val_targets: dict[int, int], repo_cap: int, family_cap: int,
    stub_share: float, seed: str = "draw", few: int = FEW, stretch: int = STRETCH, rounds: int = 200,
) -> DataFrame:
    """rows with phase and status: validation, train, reserved, not_drawn, cap_repo, cap_family or cap_stub.

    rows: id, repo, fam, boilerplate, stub, band, reserved, pile (0: the first). Stub caps are stub_share of each split's targets.
    """
    flags = {f: F.coalesce(f, F.lit(False)) for f in ("boilerplate", "stub", "reserved")}
    rows = rows.withColumns(flags).withColumn("k", F.md5(F.concat_ws("|", F.lit(seed), "id")))
    first = F.coalesce(F.col("pile") == 0, F.lit(False))
    phase = F.when(F.col("reserved") & ~first, 0).when(F.col("reserved"), -1).when(first, 1).otherwise(2 + F.coalesce("band", F.lit(0)))
    rows = rows.withColumn("phase", phase.cast("int")).withColumn("split", F.when(F.col("phase") == 0, "validation").otherwise("train"))
    caps = tuple(int(sum(t.values()) * stub_share) for t in (val_targets, targets))
    asked = rows.where("phase >= 0").withColumn("counters", _counters(targets, val_targets, repo_cap, family_cap, caps))
    kept = rows.where("phase < 0").withColumn("status", F.lit("reserved"))
    if asked.count() <= few:
        asked = stored(spark, asked.withColumn("at", F.monotonically_increasing_id()), "draw-rows")
        found = _settled(asked.withColumn("before", F.array_repeat(F.lit(0).cast("long"), F.size("counters"))))
        drawn = asked.join(found, "at")
    else:
        ranked = global_rank(spark, asked, ["phase", "k", "id"], "at")
        base = stored(spark, ranked.withColumn("at", F.col("at").cast("long")).withColumn("stretch", F.floor((F.col("at") - 1) / stretch)), "draw-rows")
        now = base.select("at", "phase", "k", "split", "stretch", "counters", F.lit(None).cast("boolean").alias("taken"), F.lit(None).cast("string").alias("status"))
        for _ in range(rounds):
            found = now.join(_bounds(now), "at", "left").withColumn("first", F.expr("get(filter(bounds, b -> b.high >= b.cap), 0)"))
            taken = F.when(F.col("bounds").isNull(), F.col("taken")).when(F.col("first").isNull(), True).when(F.exists("bounds", lambda b: b["low"] >= b["cap"]), False)
            full = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("first.kind") + 1)
            why = F.when(F.col("first.low") >= F.col("first.cap"), F.when(full == "", F.when(F.col("split") == "validation", "reserved").otherwise("not_drawn")).otherwise(full))
            status = F.when(F.col("bounds").isNull(), F.col("status")).when(F.col("first").isNull(), F.col("split")).otherwise(why)
            before = F.transform("bounds", lambda b: b["low"])
            columns = ["at", "phase", "k", "split", "stretch", "counters"]
            now = stored(spark, found.select(*columns, taken.alias("taken"), status.alias("status"), before.alias("before")), "draw-round")
            left = now.where("status IS NULL").count()
            if left <= few:
                break
        else:
            raise RuntimeError(f"the draw did not settle in {rounds} rounds")
        # what settled in this round counts for the rows that are left
        last = _bounds(now.drop("before")).select("at", F.transform("bounds", lambda b: b["low"]).alias("before"))
        rest = _settled(now.drop("before").where("status IS NULL").join(last, "at"))
        drawn = base.join(now.where("status IS NOT NULL").select("at", "status").union(rest), "at").drop("stretch")
    drawn = drawn.drop("at", "counters")
    return drawn.unionByName(kept.select(*drawn.columns)).drop("k", "split")
