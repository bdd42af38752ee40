"""Near copies for the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash fingerprints through BK-trees, as in simhash. At 0.8 two fingerprints of a set differ
in about ten of 64 bits with a deviation of three, and no blocks index a radius that wide. So a set has WORDS
fingerprints of 64 bits, each from hashes of its own, and each is indexed by its four 16-bit blocks: the shards of the index
are the fingerprints with one value in one block, each with a BK-tree, searched with radius RADIUS. A pair
that differs in a share p of its bits meets in one shard with probability (1 - p)^16 * P(Bin(48, p) <= 10).
p is about 0.15 at 0.8 (up to 0.19 for a few shingles, so sets of up to SMALL shingles have SMALL_WORDS), and a
pair at 0.8 meets in no shard with probability below 4e-6, less above it. Equal sets collapse before; a set of
fewer than four shingles has no other partner.

A pair within the radius counts only if a second word of both, the other of a pair of words, differs in at most PROOF of its 64 bits. That keeps 99.8 %
of pairs at 0.8 (97 % of small sets, and other words are other tries) and one random pair in 2,700, so that what
a shard joins are near documents even where it holds many thousands of unrelated ones. What pairs that count join in a shard is a bucket.
Shards above SHARD_ROWS (judged by a sample of one document in SAMPLE, which decides only on the split) are dealt into blocks of which
each two meet in one group. The index is built for a few words at a time, so that shuffle files stay small.

The first few words give first components: each document is compared, exactly, with the smallest document of its largest bucket, then
with the smallest of each other bucket that holds it and is not joined to it yet; that joins most of a group of near copies. Components that
buckets still join are clusters. In the shards of all other words documents of one cluster count as joined, and a bucket yields
one pair for each further cluster in it, never one for each document, so edges grow with the documents and not with
their buckets; such pairs make clusters of clusters. All clusters are compared in full, dealt into blocks of about BLOCK documents by a hash, and each
two blocks meet in one group, so a large cluster is many tasks. A group counts common shingles by products of incidence matrices, links only
pairs whose exact similarity reaches the threshold, and returns a spanning forest of its links. Components of
all links share the smallest doc_id.

Texts without words (null, empty) are equal; one with fewer than five words is one shingle. Rows without doc_id
have no component. A doc_id stands for one text (deduplicated sees to that); repeated rows repeat. Very long texts
are read whole, their hashes in pieces. Empty tables give empty results. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, discard, release, stored
from .simhash import _LOWER, SEED, SHARD_ROWS, TREE_ROWS, BKForest, _roots, components

SHINGLE, RADIUS, PROOF, BLOCK = 5, 10, 18, 512
WORDS, SMALL, SMALL_WORDS = 52, 36, 128
#: Words of the first components, words of the index that are built in one go after them, and the share of documents that large shards are judged by.
FIRST, PIECES, SAMPLE = 4, [4, 16, 28, 40, WORDS, SMALL_WORDS], 16
#: Edges that one task unites (16 bytes each).
FEW = 1_000_000
#: The threshold as a fraction, so that comparisons are exact.
LEAST, OF = 4, 5
_SALT = np.random.default_rng(SEED).integers(0, 1 << 63, SMALL_WORDS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of A-Z-lowered words."""
    data = [w.encode("utf-8", "surrogatepass") for w in WORD_RE.findall(text.translate(_LOWER))] if text else []
    if not data:
        return np.zeros(0, np.uint64)
    joined = b" ".join(data)
    ends = np.cumsum([len(w) + 1 for w in data]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(data) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes, bijectively (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The SimHash words of a set of shingle hashes: a bit is 1 if set in over half of the hashes of its word."""
    n = len(hashes)
    if n < LEAST:
        return np.zeros(0, np.uint64)
    salt = _SALT[: SMALL_WORDS if n <= SMALL else WORDS]
    ones = np.zeros(64 * len(salt), dtype=np.int64)
    for at in range(0, n, 255):
        words = mixed(hashes[at : at + 255, None] ^ salt)
        bits = np.unpackbits(words.view(np.uint8).ravel(), bitorder="little").reshape(len(words), -1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, words = [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            keys.append(xxhash.xxh128_digest(found.tobytes()))
            words.append(fingerprints(found).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "same", "words"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def linked(sets: list[np.ndarray], wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, root) that join what pairs of sets at the threshold join."""
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[token] > 1
    rows, token = rows[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    common = np.zeros((len(sets), len(sets)))
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, wide):
        low, high = np.searchsorted(token, (at, at + wide))
        stands = np.zeros((len(sets), wide), dtype=np.float32)
        stands[rows[low:high], token[low:high] - at] = 1
        common += stands @ stands.T
    a, b = np.nonzero(np.triu(OF * common >= LEAST * (sizes[:, None] + sizes - common), 1))
    parent = np.arange(len(sets))
    while True:
        ra, rb = _roots(parent, a), _roots(parent, b)
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    root = _roots(parent, np.arange(len(sets)))
    child = np.flatnonzero(root != np.arange(len(sets)))
    return child, root[child]


def _group_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; one group is held at a time."""

    def edges() -> pa.RecordBatch:
        child, root = linked(sets)
        a, b = np.array(ids, np.int64)[child], np.array(ids, np.int64)[root]
        low, high = np.minimum(a, b), np.maximum(a, b)
        return pa.RecordBatch.from_arrays([pa.array(high[low < high]), pa.array(low[low < high])], ["a", "b"])

    now, ids, sets = None, [], []
    for batch in batches:
        shingles = batch.column("shingles")
        values, at = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        for i, (group, doc) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high"))), batch.column("doc_id").to_pylist())):
            if group != now:
                if len(ids) > 1:
                    yield edges()
                now, ids, sets = group, [], []
            ids.append(doc)
            sets.append(values[at[i] : at[i + 1]].copy())
    if len(ids) > 1:
        yield edges()


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the trees of each a and b, under the smaller root."""
    while True:
        ra, rb = _roots(parent, a), _roots(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _differ(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[i] ^ x[j])


def _starred(parent: np.ndarray, shard: np.ndarray, fp: np.ndarray, proof: np.ndarray, free: np.ndarray, rounds: int = 16, few: int = 64) -> None:
    """Join, in shards with many free rows, all that count as near to one of them, a few times over."""
    for _ in range(rounds):
        _, first, which, n = np.unique(shard[free], return_index=True, return_inverse=True, return_counts=True)
        many = n[which] >= few
        if not many.any():
            return
        lead = free[(first + n // 2)[which]]
        near = many & (_differ(fp, free, lead) <= RADIUS) & (_differ(proof, free, lead) <= PROOF)
        _join(parent, free[near], lead[near])
        free = free[many & ~near]


def bucket_pairs(shard: np.ndarray, fp: np.ndarray, rep: np.ndarray, label: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, n for rows sorted by (shard, fp): b is the smallest row of a bucket with n labels, a the smallest of each other label in it."""
    same = shard[1:] == shard[:-1]
    several = np.append(False, same) | np.append(same, False)
    shard, fp, rep, label, proof = (x[several] for x in (shard, fp, rep, label, proof))
    if not len(rep):
        return rep, rep, rep
    fp, proof, rows = fp.view(np.uint64), proof.view(np.uint64), np.arange(len(rep))
    parent = rows.copy()
    new = np.append(True, (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1]))
    lead = rows[new][np.cumsum(new) - 1]
    equal = _differ(proof, rows, lead) <= PROOF  # equal fingerprints that count are one node of the tree
    _join(parent, rows[equal], lead[equal])
    order = np.lexsort((label, shard))
    again = (shard[order][1:] == shard[order][:-1]) & (label[order][1:] == label[order][:-1])
    _join(parent, order[1:][again], order[:-1][again])
    nodes = rows[new | ~equal]
    _starred(parent, shard, fp, proof, nodes)
    forest = BKForest(shard[nodes], fp[nodes])
    for x, y in forest.links(RADIUS, _roots(parent, nodes)):
        x, y = nodes[x], nodes[y]
        near = _differ(proof, x, y) <= PROOF
        _join(parent, x[near], y[near])
    bucket = _roots(parent, rows)
    order = np.lexsort((rep, label, bucket))
    bucket, label, rep = bucket[order], label[order], rep[order]
    least = np.append(True, (bucket[1:] != bucket[:-1]) | (label[1:] != label[:-1]))  # the smallest row of each label in a bucket
    bucket, rep = bucket[least], rep[least]
    order = np.lexsort((rep, bucket))
    bucket, rep = bucket[order], rep[order]
    start = np.append(True, bucket[1:] != bucket[:-1])
    which = np.cumsum(start) - 1
    first, n = rep[start][which], np.bincount(which)[which]
    return rep[~start], first[~start], n[~start]


def _shard_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and fingerprint; whole shards are searched together, about TREE_ROWS rows at a time."""

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = bucket_pairs(*columns)
        for i in range(0, len(out[0]), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65_536]) for x in out], ["a", "b", "n"])

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("shard", "fp", "rep", "label", "proof")])
        rows += batch.num_rows
        if rows >= TREE_ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last shard may go on
            if cut:
                yield from found([x[:cut] for x in columns])
            held, rows = [[x[cut:] for x in columns]], len(columns[0]) - cut
    if rows:
        yield from found([np.concatenate(x) for x in zip(*held)])


def shards(reps: DataFrame, low: int, high: int) -> DataFrame:
    """(shard, fp, rep, label, proof): each of the words from low to high by the value of each of its four blocks. proof: the other word of its pair."""
    words = reps.select("rep", "label", "words", F.posexplode(F.slice("words", low + 1, high - low)).alias("word", "fp"))
    words = words.select("rep", "label", (F.col("word") + low).alias("word"), "fp", F.get("words", (F.col("word") + low).bitwiseXOR(F.lit(1))).alias("proof"))
    blocks = words.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    value = "shiftleft(cast(word * 4 + k AS long), 16) | (shiftrightunsigned(fp, 16 * k) & 65535L)"
    return blocks.select(F.expr(value).alias("shard"), "fp", "rep", "label", "proof")


def large_shards(spark: SparkSession, reps: DataFrame, shard_rows: int) -> DataFrame | None:
    """shard, blocks of the shards above shard_rows, by a sample of the documents; none if there are none."""
    some = shards(reps.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0), 0, SMALL_WORDS)
    large = some.groupBy("shard").agg(F.ceil(F.count("*") * SAMPLE / shard_rows).cast("long").alias("blocks")).where("blocks > 1")
    large = stored(spark, large, "large-shards")
    return None if large.isEmpty() else large


def bucketed(spark: SparkSession, reps: DataFrame, low: int, high: int, large: DataFrame | None) -> DataFrame:
    """(a, b, n) of every bucket of the index for the words from low to high; reps: rep, label, words."""
    rows = shards(reps, low, high)
    if large is not None:
        own = rows.join(large, "shard", "left").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
        own = own.withColumn("other", F.explode(F.expr("CASE WHEN blocks IS NULL THEN array(-1L) ELSE filter(sequence(0L, blocks - 1), x -> x <> own) END")))
        shard = F.when(F.col("other") < 0, F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")))
        rows = own.select(shard.alias("shard"), "fp", "rep", "label", "proof")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "fp")
    found = stored(spark, dealt.mapInArrow(_shard_pairs, "a long, b long, n long"), "buckets")
    release(spark)
    return found


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges (a, b) of the task."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        parent = np.arange(len(nodes))
        _join(parent, at[: len(a)], at[len(a) :])
        root = _roots(parent, np.arange(len(nodes)))
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["node", "component"])


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """As components, of which the rounds are for more than FEW edges; as many as that are united in one task."""
    edges = stored(spark, edges.toDF("a", "b").distinct(), "links")
    if edges.count() > FEW:
        return components(spark, edges)
    return stored(spark, edges.repartition(1).mapInArrow(_united, "node long, component long"), "components")


def ends(pairs: DataFrame) -> DataFrame:
    """The documents of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def shingle_sets(spark: SparkSession, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles of the wanted documents."""
    return stored(spark, texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), "shingle-sets")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by their exact similarity."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(other, "b").where(OF * common >= LEAST * (F.size("x") + F.size("y") - common)).select("a", "b")


def labelled(rows: DataFrame, joined: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component that joined (node, component) gives a column, that itself where it has none."""
    of = joined.select(F.col("node").alias(column), F.col("component").alias("_component"))
    return rows.join(of, column, "left").withColumn(name, F.coalesce("_component", column)).drop("_component")


def clusters(spark: SparkSession, pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, component) of the documents whose component in joined is one of several that pairs (a, b) join to a cluster; component is the cluster."""
    ends = labelled(labelled(pairs, joined, "a", "x"), joined, "b", "y").where("x <> y")
    edges = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    found = connected(spark, edges)
    found = found.union(found.select("component", "component")).distinct().toDF("of", "component")
    nodes = joined.union(joined.select("component", "component")).distinct().toDF("node", "of")
    single = found.select(F.col("of").alias("node"), "component")  # components of one document aren't in joined
    return nodes.join(found, "of").select("node", "component").union(single).distinct()


def widened(spark: SparkSession, known: DataFrame, first: DataFrame, later: DataFrame) -> DataFrame:
    """(node, component) of the documents of all clusters: the first ones (node, component), and those that later pairs (a, b) join out of labels.

    known: rep, label; a label is a first cluster, a component or a document.
    """
    named = lambda x, y: known.select(F.col("rep").alias(x), F.col("label").alias(y))
    ends = later.join(named("a", "x"), "a").join(named("b", "y"), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    found = connected(spark, ends.where("a > b").distinct())
    found = found.union(found.select("component", "component")).distinct().toDF("label", "component")
    alone = first.select(F.col("component").alias("label")).distinct().join(found, "label", "left_anti").select("label", F.col("label").alias("component"))
    return known.join(found.union(alone), "label").select(F.col("rep").alias("node"), "component")


def links(spark: SparkSession, sets: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a > b, that join what the pairs at the threshold within clusters (node, component) join."""
    blocks = found.groupBy("component").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    member = found.join(blocks, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("own"))
    other = F.explode(F.expr("filter(sequence(0L, blocks - 1), x -> x <> own OR blocks = 1)")).alias("other")
    meets = member.select("doc_id", "cluster", "own", other).select("doc_id", "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = meets.join(sets, "doc_id").repartition(parts, "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.select("cluster", "low", "high", "doc_id", "shingles").mapInArrow(_group_edges, "a long, b long").distinct()


def apart(pairs: DataFrame, tried: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) in two components of joined (node, component), but for those tried."""
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return labelled(labelled(pairs, joined, "a", "x"), joined, "b", "y").where("x <> y").select("a", "b")


def groups(spark: SparkSession, docs: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, component_id for every row with a doc_id."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stored(spark, texts.mapInArrow(_sketches, "doc_id long, same binary, words array<long>"), "sketches")
    firsts = stored(spark, marked.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sketch-firsts")
    copies = stored(spark, marked.select("same", "doc_id").join(firsts.where("n > 1"), "same").where("doc_id > rep").select("doc_id", "rep").distinct(), "sketch-copies")
    reps = marked.join(copies, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"), "words")
    reps = stored(spark, reps, "sketch-reps")
    large = large_shards(spark, reps, shard_rows)
    pieces = [bucketed(spark, reps, 0, FIRST, large)]
    # a document meets the same first in many buckets: stored, so that joins see each pair once
    pairs = stored(spark, pieces[0].groupBy("a", "b").agg(F.max("n").alias("n")), "bucket-pairs")
    sets = shingle_sets(spark, texts, ends(pairs))
    star = stored(spark, pairs.groupBy("a").agg((-F.max(F.struct("n", (-F.col("b")).alias("least")))["least"]).alias("b")), "star-pairs")
    joined = connected(spark, compared(star, sets))
    again = stored(spark, compared(apart(pairs.select("a", "b"), star, joined), sets), "star-links")
    joined = connected(spark, joined.union(again))  # stars instead of the links they came from: fewer rounds
    release(spark)
    # the other words, where documents of one cluster count as joined
    first = clusters(spark, pairs.select("a", "b"), joined)
    placed = joined.join(first, "node", "left_anti").union(first)
    known = stored(spark, labelled(reps.drop("label"), placed, "rep", "label").select("rep", "label", "words"), "sketch-labels")
    pieces += [bucketed(spark, known, low, high, large) for low, high in zip(PIECES, PIECES[1:])]
    later = stored(spark, reduce(DataFrame.union, pieces[1:]).select("a", "b").distinct(), "bucket-pairs")
    discard(spark, reps, *pieces)
    other = shingle_sets(spark, texts, ends(later).join(ends(pairs), "doc_id", "left_anti"))
    every = sets.union(other)
    rest = widened(spark, known, first, later)
    more = stored(spark, links(spark, every, rest, block), "cluster-links")
    discard(spark, known, pairs, later, star, again, sets, other)
    release(spark)
    found = connected(spark, joined.union(more))
    own = marked.select("doc_id").join(copies, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    out = stored(spark, own.join(found, own["rep"] == found["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")), "near-groups")
    discard(spark, marked, firsts, copies, more)
    return out
