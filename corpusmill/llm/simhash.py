"""SimHash near-duplicates through BK-trees.

A document's fingerprint has bit b set if over half of its shingle hashes have it. Fingerprints at
three or fewer differing bits link; components of linked documents share the smallest doc_id.

Copies collapse first: a fingerprint is indexed once, with its smallest doc_id. Two fingerprints at
distance 3 or less agree on one of four 16-bit blocks, so the shards of the index are the
fingerprints that share (block, value), each with a BK-tree whose children are keyed by their
Hamming distance to the parent; a search follows only edges within the radius. A shard above
SHARD_ROWS is dealt again by four blocks of its other bits (the same argument), and again until none is
above it or seven bits are left, so a value that a third of all fingerprints share does not become one
task. Trees of several shards are built and searched together, level by level, in arrays, about TREE_ROWS
rows at a time. Broadcasting every shard tree to every task would grow with the corpus, so shards travel by
hash to the task that owns them instead.

A task returns a spanning forest of its links (at most one edge a fingerprint), never all pairs.
Components then come from alternating large-star and small-star rounds over stored edge tables.

Texts without words have fingerprint zero and link like any other; null is such a text. Rows without
doc_id keep their fingerprint and take the component of others with it. Repeated rows repeat; rows that
share a doc_id with different texts are different rows with that id. Very long texts are hashed whole, in
pieces. Empty tables give empty results. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, release, stored

SEED, RADIUS, BLOCKS = 42, 3, 4
SHARD_ROWS, TREE_ROWS = 50_000, 200_000
FRONTIER = 400_000
_LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of A-Z-lowered words in shingles, repeats included."""
    words = WORD_RE.findall(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    joined = b" ".join(data)
    ends = np.cumsum([len(w) + 1 for w in data]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(data) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(data) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class BKForest:
    """BK-trees of many shards in one set of arrays: node i is row i, edges are sorted by (parent, distance)."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        self.fps = fps
        _, first, self.shard = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[self.shard]
        waiting = np.setdiff1d(np.arange(len(fps)), first)
        at = self.root[waiting]
        keys, children, self.levels = [], [], []
        while len(waiting):
            key = at * 65 + np.bitwise_count(fps[waiting] ^ fps[at]).astype(np.int64)
            edge, index, which = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[index]
            keys.append(edge)
            children.append(child)
            self.levels.append((edge // 65, child))
            rest = np.ones(len(waiting), dtype=bool)
            rest[index] = False
            waiting, at = waiting[rest], child[which][rest]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.children = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def links(self, radius: int, joined: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, earlier row) within the radius, in pieces of bounded size.

        joined: labels of rows known to be joined; a search then leaves out subtrees that wholly have its own row's label.
        """
        everything = np.arange(len(self.fps))
        if joined is not None:
            low, high = joined.copy(), joined.copy()
            for parents, below in reversed(self.levels):
                np.minimum.at(low, parents, low[below])
                np.maximum.at(high, parents, high[below])
            only = np.where(low == high, low, -1)
            everything = everything[only[self.root] < 0]
        todo = [(rows, self.root[rows]) for rows in (everything[i : i + 65_536] for i in range(0, len(everything), 65_536))]
        while todo:
            query, node = todo.pop()
            d = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            if hit.any():
                yield query[hit], node[hit]
            first = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - first
            if not (total := int(n.sum())):
                continue
            cuts = np.searchsorted(np.cumsum(n), np.arange(FRONTIER, total + FRONTIER, FRONTIER), "left") + 1
            for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts):
                m = n[a:b]
                if size := int(m.sum()):
                    step = np.arange(size) - np.repeat(np.cumsum(m) - m, m)
                    queries, nodes = np.repeat(query[a:b], m), self.children[np.repeat(first[a:b], m) + step]
                    if joined is not None:
                        apart = only[nodes] != joined[queries]
                        queries, nodes = queries[apart], nodes[apart]
                    todo.append((queries, nodes))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def spanning(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, root) that join exactly what links within each shard join."""
    forest = BKForest(shard, fps)
    parent = np.arange(len(fps))
    for a, b in forest.links(radius):
        while True:
            ra, rb = _roots(parent, a), _roots(parent, b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    root = _roots(parent, np.arange(len(fps)))
    child = np.flatnonzero(root != np.arange(len(fps)))
    return child, root[child]


def _shard_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; whole shards are searched together, about TREE_ROWS rows at a time."""

    def found(shard: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        child, root = spanning(shard, fps.view(np.uint64))
        a, b = fps[child], fps[root]
        for i in range(0, len(a), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[i : i + 65_536]), pa.array(np.minimum(a, b)[i : i + 65_536])], ["a", "b"])

    shards, fps, held = [], [], 0
    for batch in batches:
        shards.append(batch.column("shard").to_numpy())
        fps.append(batch.column("fp").to_numpy())
        held += batch.num_rows
        if held >= TREE_ROWS:
            shard, fp = np.concatenate(shards), np.concatenate(fps)
            cut = int(np.searchsorted(shard, shard[-1], "left"))  # the last shard may go on
            if cut:
                yield from found(shard[:cut], fp[:cut])
            shards, fps, held = [shard[cut:]], [fp[cut:]], len(shard) - cut
    if held:
        yield from found(np.concatenate(shards), np.concatenate(fps))


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """(shard, rest, fp) by the value of each of four blocks of the `width` bits of rest; rest loses that block.

    Two values of rest that differ in three bits or fewer agree on a block, so they share one of the new shards.
    """
    cuts = [width * i // BLOCKS for i in range(BLOCKS)] + [width]
    case = lambda of: F.expr(f"CASE k {' '.join(f'WHEN {k} THEN {of(k)}' for k in range(BLOCKS))} END")
    bits = lambda n: f"{(1 << n) - 1}L"
    value = case(lambda k: f"shiftrightunsigned(rest, {cuts[k]}) & {bits(cuts[k + 1] - cuts[k])}")
    high = lambda k: f"shiftleft(shiftrightunsigned(rest, {cuts[k + 1]}), {cuts[k]})" if k < BLOCKS - 1 else "0L"
    rest = case(lambda k: f"(rest & {bits(cuts[k])}) | {high(k)}" if k else high(k))
    spread = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(BLOCKS)])))
    return spread.select(F.xxhash64("shard", "k", value).alias("shard"), rest.alias("rest"), "fp")


def links(spark: SparkSession, fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b), a > b, between distinct fingerprints (fp): a spanning forest for each shard."""
    rows, width, parts = fps.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp"), 64, []
    while True:
        now = dealt(rows, width)
        sized = stored(spark, now.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        width -= width // BLOCKS
        last = width < 2 * BLOCKS
        small = now.join(sized if last else sized.where(F.col("n") <= shard_rows), "shard")
        parts.append(small.select("shard", "fp"))
        large = sized.where(F.col("n") > shard_rows).select("shard")
        if last or large.isEmpty():
            break
        rows = stored(spark, now.join(large, "shard"), "large-shards")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return every.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_shard_edges, "a long, b long").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), "b").union(edges.select("b", F.lit(None).cast("long")))
    nodes = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("above"))
    return not nodes.where("low IS NOT NULL AND (low < high OR above)").agg(F.count("*")).first()[0]


def components(spark: SparkSession, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (a > b); nodes alone in theirs aren't listed.

    Each round is a large-star and a small-star step; rounds grow as the logarithm of the longest path. They end when all
    edges are stars, whose centres are their smallest nodes. What a round leaves with the driver goes before the next.
    """
    now = stored(spark, edges.toDF("a", "b").distinct(), "links")
    for _ in range(limit):
        if settled(now):
            return now.toDF("node", "component")
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(spark, small.union(least.select("u", "m")).distinct().toDF("a", "b"), "links")
        release(spark)
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_duplicates(spark: SparkSession, docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    marked = stored(spark, fingerprints(docs), "fingerprints")
    reps = stored(spark, marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    found = components(spark, links(spark, reps.select("fp"), shard_rows))
    grouped = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    placed = stored(spark, grouped.join(least, "group").select("fp", "component_id"), "fingerprint-components")
    return marked.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicated(spark: SparkSession, docs: DataFrame, find: Callable = near_duplicates) -> DataFrame:
    """The documents that stay: of each component that find gives (doc_id, component_id) the one with the smallest doc_id.

    Rows without doc_id stay. Rows that repeat doc_id and text are one document, of which one row stays (the
    least by a hash of all its columns); rows that repeat a doc_id with different texts are different documents, the smaller
    hash of a text first.
    """
    named = stored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).where("doc_id IS NOT NULL"), "text-keys")
    twice = stored(spark, named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        found = stored(spark, find(spark, docs), "near-copies")
        gone = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti")
    # repeated ids get one of their own for each of their texts, below all others, and one row for each
    own = named.join(twice, "doc_id").distinct().withColumn("_own_id", -F.shiftrightunsigned(F.xxhash64("doc_id", "text_key"), 1) - 1)
    own = stored(spark, own.withColumnsRenamed({"doc_id": "_own_doc", "text_key": "_own_key"}), "own-ids")
    given = docs.join(own, (F.col("doc_id").cast("long") == F.col("_own_doc")) & (F.xxhash64("text") == F.col("_own_key")), "left").drop("_own_doc", "_own_key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = given.where("_own_id IS NOT NULL").groupBy("_own_id").agg(F.min(F.struct(F.xxhash64(*columns).alias("_own_hash"), *columns)).alias("_own_row"))
    rows = given.where("_own_id IS NULL").withColumn("_own_id", F.col("doc_id").cast("long")).unionByName(least.select(*[F.col("_own_row")[c].alias(c) for c in docs.columns], "_own_id"))
    rows = stored(spark, rows, "single-rows")
    found = stored(spark, find(spark, rows.where("_own_id IS NOT NULL").select(F.col("_own_id").alias("doc_id"), "text")), "near-copies")
    real = found.join(own, found["doc_id"] == own["_own_id"], "left").select(found["doc_id"], "component_id", F.coalesce("_own_doc", found["doc_id"]).alias("real"), F.coalesce("_own_key", F.lit(0)).alias("text_key"))
    stay = real.groupBy("component_id").agg(F.min(F.struct("real", "text_key", "doc_id"))["doc_id"].alias("_own_id")).select("_own_id")
    return rows.join(stay, "_own_id", "left_semi").unionByName(rows.where("_own_id IS NULL")).select(*columns)
