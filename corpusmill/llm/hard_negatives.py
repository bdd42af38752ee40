"""Hard negatives from vantage-point trees over norm-augmented vectors.

A row's score is its inner product with the anchor. With one more coordinate, sqrt(M^2 - |x|^2) for rows and 0 for
anchors (M the largest norm), the squared distance of a row and an anchor is |a|^2 + M^2 - 2 * score: higher scores are nearer and a
window of scores is an annulus around the anchor. The positives of an anchor are its nearest rows of the same label; the
negatives of a positive are the nearest rows of other labels inside the annulus of its window. Both come from one
search, an incremental traversal that takes subtrees and rows from a heap, nearest first, leaves out subtrees that lie wholly
inside or outside the annulus, and ends with the k-th row.

Shards: the top of the tree is fitted to a bounded sample (about SAMPLE_ROWS rows, at most twice as many, at most MAX_CELLS cells); every
row is routed to a cell by it, and a cell with more than its share of rows, copies included, is cut into slices by a hash of the id. A
task holds the tree of one shard, at most SHARD_ROWS rows or so, and streams anchors past it; beyond ANCHOR_BLOCK anchors a shard
is several tasks. Anchors first meet the sample: its k-th row in a window bounds the search, and only cells that the rest of the annulus
reaches are visited. So nothing is approximate; the sample only steers. Searches return at most k rows for each shard and
window, and the best k of those are kept. The cost grows as the number of anchors times the rows of the cells that they reach.

Scores are exact integers (in floating point below 2^53, else in Python's integers; what exceeds a long counts as its largest or smallest
value). Rows without id, label or vector take no part. Shorter vectors count as filled up with zeros. Repeated rows (id, label and vector) are one row;
rows that share an id with other labels or vectors are different rows, none of which is "other" to an anchor of that id. Ties go by id.
Windows of negative scores are empty. Empty tables give empty results. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE_ROWS, MAX_CELLS = 4_096, 1_024
SHARD_ROWS, LEAST_ROWS, ANCHOR_BLOCK = 131_072, 2_048, 200_000
LEAF = 256
_MOST = (1 << 63) - 1
_WINDOWS = "array<struct<least:long,most:long>>"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers, filled up with zeros."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    n = np.diff(ends)
    if (n == dim).all():
        return values[ends[0] : ends[-1]].reshape(len(n), dim).astype(np.int64)
    out = np.zeros((len(n), dim), np.int64)
    for row, a, b in zip(out, ends, ends[1:]):
        row[: b - a] = values[a:b]
    return out


class Query:
    """An anchor (or row) that searches: what it has computed for a tree serves all its windows."""

    def __init__(self, id: int, label: int, vector: np.ndarray, reach: float):
        self.id, self.label, self.vector = id, label, vector
        self.floats = vector.astype(np.float64)
        self.square = float(self.floats @ self.floats)
        self.base = self.square + reach
        self.slack = 1e-6 * self.base + 1e-3  # more than what rounding can move a bound by
        self.scores: dict[int, np.ndarray] = {}
        self.distances: dict[int, float] = {}


class VPTree:
    """Rows in the order of the leaves; a node has a vantage row and, for each child, the range of its distances to that."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, reach: float, leaf: int = LEAF):
        """reach: the largest squared norm of any row."""
        self.reach = reach
        floats = vectors.astype(np.float64)
        more = np.sqrt(np.maximum(reach - np.einsum("ij,ij->i", floats, floats), 0))

        def distances(i: int, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 * reach - 2 * (floats[rows] @ floats[i] + more[rows] * more[i]), 0))

        self.nodes: list = []
        order, start, todo = [], 0, [(np.argsort(ids, kind="stable"), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1 + side][0] = at
            far = distances(rows[0], rows) if len(rows) > leaf else np.zeros(1)
            if not far.any():  # few rows, or copies of one
                self.nodes.append((None, start, start + len(rows)))
                start += len(rows)
                order.append(rows)
                continue
            vantage = int(rows[far.argmax()])
            d = distances(vantage, rows)
            half = np.argpartition(d, len(rows) // 2)
            inner, outer = np.sort(half[: len(rows) // 2]), np.sort(half[len(rows) // 2 :])
            self.nodes.append((floats[vantage], [None, d[inner].min(), d[inner].max()], [None, d[outer].min(), d[outer].max()]))
            todo += [(rows[outer], at, 1), (rows[inner], at, 0)]
        rows = np.concatenate(order)
        self.ids, self.labels, self.vectors, self.floats = ids[rows], labels[rows], vectors[rows], floats[rows]
        self.exact = reach < 1 << 52

    def _scores(self, query: Query, node: int) -> np.ndarray:
        if node not in query.scores:
            _, start, stop = self.nodes[node]
            if self.exact and query.square < 1 << 52:
                found = (self.floats[start:stop] @ query.floats).astype(np.int64)
            else:
                found = self.vectors[start:stop].astype(object) @ query.vector.astype(object)
                found = np.array([min(max(x, -_MOST - 1), _MOST) for x in found], np.int64)
            query.scores[node] = found
        return query.scores[node]

    def nearest(self, query: Query, least: int, most: int, same: bool, k: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the rows of the query's label (or of others) with a score from least to most, highest first; right up to the k-th."""
        heap = [(-float(most), 0, 0, 0.0, np.inf)]
        while heap:
            key, kind, at, near, far = heapq.heappop(heap)
            if kind:
                yield at, -key
                continue
            vantage, *rest = self.nodes[at]
            if vantage is None:
                start, stop = rest
                scores = self._scores(query, at)
                fits = (scores >= least) & (scores <= most) & ((self.labels[start:stop] == query.label) == same) & (self.ids[start:stop] != query.id)
                rows = np.flatnonzero(fits)
                for i in rows[np.lexsort((self.ids[start:stop][rows], -scores[rows]))[:k]].tolist():
                    heapq.heappush(heap, (-int(scores[i]), 1, int(self.ids[start + i]), 0.0, 0.0))
                continue
            if at not in query.distances:
                query.distances[at] = float(np.sqrt(max(query.base - 2 * (vantage @ query.floats), 0)))
            d = query.distances[at]
            for child, low, high in rest:
                nearer, further = max(near, d - high, low - d), min(far, d + high)
                best, worst = (query.base - nearer * nearer) / 2 + query.slack, (query.base - further * further) / 2 - query.slack
                if best >= least and worst <= most:
                    heapq.heappush(heap, (-min(best, float(most)), 0, child, nearer, further))


class Cells:
    """The top of the tree: vantage points and radii fitted to a sample; leaves are cells."""

    def __init__(self, tree: VPTree, cells: int):
        self.vantage, self.radius, self.children, self.cells = [], [], [], 0
        rows, floats = np.arange(len(tree.ids)), tree.floats
        self.reach = tree.reach
        self.more = lambda x: np.sqrt(np.maximum(self.reach - np.einsum("ij,ij->i", x, x), 0))
        more = self.more(floats)
        todo = [(rows, None, 0, cells)]
        while todo:
            rows, parent, side, n = todo.pop()
            at = self.cells if n <= 1 or len(rows) < 2 else None
            if at is None:
                v = rows[len(rows) // 2]
                d = np.sqrt(np.maximum(2 * self.reach - 2 * (floats[rows] @ floats[v] + more[rows] * more[v]), 0))
                radius = float(np.partition(d, (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
                if not (d > radius).any():  # nothing lies outside: no cut here
                    at = self.cells
            if at is not None:
                self.cells += 1
                link = -1 - at
            else:
                link = len(self.vantage)
                self.vantage.append((floats[v], more[v]))
                self.radius.append(radius)
                self.children.append([None, None])
                todo += [(rows[d > radius], link, 1, n // 2), (rows[d <= radius], link, 0, n - n // 2)]
            if parent is not None:
                self.children[parent][side] = link
        self.leaf = not self.vantage

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        floats = vectors.astype(np.float64)
        more, out = self.more(floats), np.zeros(len(floats), np.int64)
        todo = [] if self.leaf else [(0, np.arange(len(floats)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                point, extra = self.vantage[at]
                d = np.sqrt(np.maximum(2 * self.reach - 2 * (floats[rows] @ point + more[rows] * extra), 0))
                inside = d <= self.radius[at]
                todo += [(self.children[at][0], rows[inside]), (self.children[at][1], rows[~inside])]
        return out

    def reached(self, query: Query, windows: list[tuple[int, int]]) -> list[int]:
        """The cells where a score within one of the windows may be."""
        if self.leaf:
            return [0]
        out, todo = [], [(0, 0.0, np.inf)]
        while todo:
            at, near, far = todo.pop()
            best, worst = (query.base - near * near) / 2 + query.slack, (query.base - far * far) / 2 - query.slack
            if not any(best >= least and worst <= most for least, most in windows):
                continue
            if at < 0:
                out.append(-1 - at)
                continue
            d, radius = float(np.sqrt(max(query.base - 2 * (self.vantage[at][0] @ query.floats), 0))), self.radius[at]
            todo += [(self.children[at][0], max(near, d - radius), min(far, d + radius)), (self.children[at][1], max(near, radius - d), far)]
        return out


def _unique(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the rows that repeat id, label and vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, labels, vectors
    first = {}
    for i, key in enumerate(zip(ids.tolist(), labels.tolist(), map(bytes, vectors))):
        first.setdefault(key, i)
    keep = np.array(list(first.values()))
    return ids[keep], labels[keep], vectors[keep]


class Index:
    """Rows (id, label, vector; stored) with their cells, and what a search needs to know of them."""

    def __init__(self, spark: SparkSession, rows: DataFrame, k: int, sample_rows: int, shard_rows: int, anchor_block: int):
        self.spark, self.rows, self.k, self.anchor_block = spark, rows, k, anchor_block
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        n, reach, dim = rows.agg(F.count("*"), F.max(square), F.max(F.size("vector"))).first()
        self.n, self.reach, self.dim = n, (reach or 0.0) * (1 + 1e-12), dim or 0
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.shard_rows = min(shard_rows, max(LEAST_ROWS, n // (2 * self.parts)))
        taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(n // sample_rows, 1))) == 0).limit(2 * sample_rows).toArrow()
        ids, labels = (taken.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        sample = _unique(ids, labels, matrix(taken.column("vector").combine_chunks(), self.dim) if len(ids) else np.zeros((0, self.dim), np.int64))
        self.sample = VPTree(*sample, self.reach) if len(sample[0]) else None
        if self.sample:
            self.cells = Cells(self.sample, min(MAX_CELLS, -(-n // self.shard_rows)))
            sizes = self._routed().groupBy("cell").count().collect()  # at most MAX_CELLS rows
            self.slices = {r.cell: -(-r["count"] // (2 * self.shard_rows)) for r in sizes}

    def _routed(self) -> DataFrame:
        cells, dim = self.cells, self.dim

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = pa.array(cells.route(matrix(batch.column("vector"), dim)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "vector")), cell], ["id", "label", "vector", "cell"])

        return self.rows.mapInArrow(route, "id long, label long, vector array<long>, cell long")

    def _visits(self, anchors: DataFrame, same: bool) -> DataFrame:
        """The anchors at each cell that they reach, their windows narrowed by what the sample has."""
        sample, cells, dim, k = self.sample, self.cells, self.dim, self.k

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, found = matrix(batch.column("vector"), dim), []
                for i, windows in enumerate(batch.column("windows").to_pylist()):
                    query = Query(batch.column("id")[i].as_py(), batch.column("label")[i].as_py(), vectors[i], sample.reach)
                    narrow = []
                    for w in windows:
                        best = list(islice(sample.nearest(query, w["least"], w["most"], same, k), k))
                        narrow.append((max(w["least"], best[-1][1]) if len(best) == k else w["least"], w["most"]))
                    found.append((narrow, cells.reached(query, narrow)))
                windows = pa.array([[{"least": a, "most": b} for a, b in narrow] for narrow, _ in found], pa.list_(pa.struct([("least", pa.int64()), ("most", pa.int64())])))
                columns = [*(batch.column(c) for c in ("key", "id", "label", "vector")), windows, pa.array([c for _, c in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "label", "vector", "windows", "cells"])

        return anchors.mapInArrow(visit, f"key long, id long, label long, vector array<long>, windows {_WINDOWS}, cells array<long>")

    def search(self, anchors: DataFrame, same: bool) -> DataFrame:
        """key, most, id, score: for each window of each anchor (key, id, label, vector, windows) the k highest scores in it."""
        blocks = max(1, -(-anchors.count() // self.anchor_block))
        slices = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in self.slices.items() for x in pair]), F.col("cell"))
        hash_ = F.xxhash64("id")
        rows = self._routed().withColumn("slice", F.pmod(hash_, slices)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = rows.select("cell", "slice", "block", F.lit(0).alias("role"), F.lit(None).cast("long").alias("key"), "id", "label", "vector", F.lit(None).cast(_WINDOWS).alias("windows"))
        visits = self._visits(anchors, same).withColumn("cell", F.explode("cells")).where(slices.isNotNull())
        visits = visits.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - F.lit(1).cast("long")))).withColumn("block", F.pmod(F.col("key"), F.lit(blocks)).cast("int"))
        both = rows.unionByName(visits.select("cell", "slice", "block", F.lit(1).alias("role"), "key", "id", "label", "vector", "windows"))
        shard = ["cell", "slice", "block"]
        reach, dim, k = self.reach, self.dim, self.k

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, tree = None, [], None
            for whole in batches:
                marks = np.stack([whole.column(c).to_numpy() for c in (*shard, "role")], axis=1)
                cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
                for a, b in zip(cuts, cuts[1:]):
                    batch, mark = whole.slice(a, b - a), tuple(marks[a, :3].tolist())
                    if mark != now:
                        now, parts, tree = mark, [], None
                    ids, labels, vectors = batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vector"), dim)
                    if marks[a, 3] == 0:
                        parts.append((ids, labels, vectors))
                        continue
                    if tree is None and parts:
                        tree, parts = VPTree(*_unique(*(np.concatenate(x) for x in zip(*parts))), reach), []
                    if tree is None:  # a slice without rows
                        continue
                    out = []
                    for i, (key, windows) in enumerate(zip(batch.column("key").to_pylist(), batch.column("windows").to_pylist())):
                        query = Query(int(ids[i]), int(labels[i]), vectors[i], reach)
                        for w in windows:
                            out += [(key, w["most"], *hit) for hit in islice(tree.nearest(query, w["least"], w["most"], same, k), k)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["key", "most", "id", "score"])

        dealt = both.repartition(self.parts, *shard).sortWithinPartitions(*shard, "role")
        found = dealt.mapInArrow(searched, "key long, most long, id long, score long")
        order = Window.partitionBy("key", "most").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    spark: SparkSession, rows: DataFrame, anchors: DataFrame, k: int = 5, low: int = 80, of: int = 100,
    sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows, anchors: id long, label, vector array<long>; anchors are among the rows. For each of an anchor's first k rows of its label, the first k
    rows of other labels with low * positive_score <= of * negative_score <= of * positive_score.
    """
    slim = lambda frame: frame.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    rows = stored(spark, slim(rows), "vectors")
    anchors = slim(anchors).withColumn("key", F.xxhash64("id", "label", "vector")).dropDuplicates(["key"])
    anchors = stored(spark, anchors.withColumn("windows", F.expr(f"array(named_struct('least', cast({-_MOST} AS long), 'most', {_MOST}L))")), "anchors")
    index = Index(spark, rows, k, sample_rows, shard_rows, anchor_block)
    if not index.sample:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    positives = stored(spark, index.search(anchors, True).select("key", F.col("id").alias("positive_id"), F.col("score").alias("most")), "positives")
    # a window for each score that a positive has, from low / of of it up
    scores = positives.where("most >= 0").groupBy("key").agg(F.collect_set("most").alias("scores"))
    least = F.expr(f"transform(scores, s -> named_struct('least', s - (s div {of}) * {of - low} - (s % {of}) * {of - low} div {of}, 'most', s))")
    asking = anchors.drop("windows").join(scores, "key").select("key", "id", "label", "vector", least.alias("windows"))
    negatives = index.search(stored(spark, asking, "asking"), False).select("key", "most", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    named = positives.join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return named.join(negatives, ["key", "most"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("most").alias("positive_score"), "negative_score")
