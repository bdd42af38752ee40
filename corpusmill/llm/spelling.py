"""Spelling variants by two-dimensional range reporting over wavelet trees.

Words are maximal runs of letters (Latin-1) with A-Z lowered; those with enough code points and occurrences are compared.
Two words are near if one inserted, deleted or replaced code point makes one of the other. Take the words of one
length in forward order and in the order of their reversals: for each edit position i of a word, those that begin with
its first i code points are an interval of the one order, those that end as it does after the edit an interval of the
other. A wavelet tree over the permutation between the orders reports the words in both intervals, in
O(log n) for each word reported: exactly the near ones, with no candidates to verify.

An edit spares one half of a word, so trees are dealt by (length, half, text of the half): a word is
in the tree of its first half and in that of its second, and a query asks the first for the edits after the half
and the second for those before it. Halves are dealt into buckets by hash, about SHARD_WORDS words each; a bucket that
one common half makes larger is cut into slices of its words, each a tree of its own, and queries go to every slice. A task
holds one tree and streams queries past it. It returns for each word the number of near words and the best of them, never pairs.
Edits that give the same word at several positions count once, at the first.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least `ratio` times its own
count. Counts grow by that factor with each step, so chains are short and roots come from few rounds of doubling.

Null and empty texts have no words. A null doc_id is an empty one in the hash of `noise`. Repeated rows count again.
Very long texts, and very long words, are read whole. An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a tree, and code points of the queries that are answered together.
SHARD_WORDS, BATCH = 50_000, 65_536
_ROWS = "len int, side int, bucket long, slice long, role int, word string, n long"
_FOUND = "word string, n_near long, best struct<less:long,word:string>"


class WaveletTree:
    """Over a permutation of 0..n-1: which of the values at positions [a, b) lie in [c, d)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros, self.starts = [], []
        for level in range(self.bits - 1, -1, -1):
            one = values >> level & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - one))))
            self.starts.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every value reported, for arrays of rectangles."""
        which, prefix = np.arange(len(a)), np.zeros(len(a), np.int64)
        for level, (zeros, start) in zip(range(self.bits - 1, -1, -1), zip(self.zeros, self.starts)):
            low, high = zeros[a], zeros[b]
            which = np.concatenate((which, which))
            prefix = np.concatenate((prefix, prefix + (1 << level)))
            a, b = np.concatenate((low, start + a - low)), np.concatenate((high, start + b - high))
            open_ = (a < b) & (prefix < d[which]) & (prefix + (1 << level) > c[which])
            which, prefix, a, b = which[open_], prefix[open_], a[open_], b[open_]
        return which, prefix


def _matrix(words: list[bytes]) -> np.ndarray:
    """One row a word, one column a code point (all words have one length)."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _narrowed(rows: np.ndarray, column: int, low: np.ndarray, high: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the intervals [low, high) of sorted rows that have the code points `by` in a column."""

    def first(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while (busy := a < b).any():
            middle = (a + b) // 2
            less = np.zeros(len(a), bool)
            less[busy] = rows[middle[busy], column] < least[busy]
            a, b = np.where(busy & less, middle + 1, a), np.where(busy & ~less, middle, b)
        return a

    start = first(low, high, by.astype(np.int64))
    return start, first(start, high, by.astype(np.int64) + 1)


def _intervals(rows: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) of the rows that begin with the first i code points of each query, i from 0 to most."""
    low, high = (np.zeros((most + 1, len(queries)), np.int64) for _ in "ab")
    high[0] = len(rows)
    for i in range(most):
        low[i + 1], high[i + 1] = _narrowed(rows, i, low[i], high[i], queries[:, i])
    return low, high


class Speller:
    """The words of one tree, all of one length, each with its count."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], np.asarray(n, np.int64)[order]
        back = np.array(sorted(range(len(words)), key=lambda i: self.words[i][::-1]), np.int64)
        self.forward = _matrix(self.words)
        self.backward = self.forward[back, ::-1]
        self.at = back  # rank in reverse order -> rank in forward order
        rank = np.empty(len(words), np.int64)
        rank[back] = np.arange(len(words))
        self.tree = WaveletTree(rank)

    def near(self, queries: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for the near words of queries of one length whose edit lies after (side 0) or before (1) the half."""
        q, length = _matrix(queries), self.forward.shape[1]
        m, half = q.shape[1], length // 2
        skip, own = (1, 1) if m == length else (0, 1) if m < length else (1, 0)  # code points at the edit of the query, of the word
        places = m - skip + 1
        at = range(half, places) if side == 0 else range(min(half, places))
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, after = at[-1], m - skip - at[0]
        low, high = _intervals(self.forward, q, before)
        rlow, rhigh = _intervals(self.backward, q[:, ::-1], after)
        which, a, b, c, d = [], [], [], [], []
        for i in at:
            rest = m - skip - i
            some = (low[i] < high[i]) & (rlow[rest] < rhigh[rest])
            if skip > own and i:  # of a run of equal code points only the first is deleted
                some &= q[:, i] != q[:, i - 1]
            some = np.flatnonzero(some)
            for out, x in zip((which, a, b, c, d), (some, low[i][some], high[i][some], rlow[rest][some], rhigh[rest][some])):
                out.append(x)
            which[-1] = which[-1] * len(at) + (i - at[0])
        which, a, b, c, d = (np.concatenate(x) for x in (which, a, b, c, d))
        hit, value = self.tree.report(a, b, c, d)
        query, i, word = which[hit] // len(at), which[hit] % len(at) + at[0], self.at[value]
        if skip == own:
            keep = self.forward[word, i] != q[query, i]  # not the word itself
        elif own:
            keep = (i == 0) | (self.forward[word, i] != q[query, np.maximum(i - 1, 0)])  # inserted at the first place that gives it
        else:
            keep = np.ones(len(word), bool)
        return query[keep], word[keep]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tree, words (role 0) before queries (1); one tree is held at a time."""
    now, words, counts, speller, waiting, size = None, [], [], None, {}, 0

    def answered() -> Iterator[pa.RecordBatch]:
        for queries in waiting.values():
            query, word = speller.near(queries, now[1])
            if not len(query):
                continue
            order = np.lexsort((word, -speller.n[word], query))  # words are in code-point order
            query, word = query[order], word[order]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            near = np.diff(np.append(first, len(query)))
            best = pa.StructArray.from_arrays([pa.array(-speller.n[word[first]]), pa.array([speller.words[i].decode("latin-1") for i in word[first]], pa.string())], ["less", "word"])
            names = pa.array([queries[i].decode("latin-1") for i in query[first]], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(near.astype(np.int64)), best], ["word", "n_near", "best"])

    for batch in batches:
        tree = zip(*(batch.column(c).to_pylist() for c in ("len", "side", "bucket", "slice")))
        for key, role, word, n in zip(tree, *(batch.column(c).to_pylist() for c in ("role", "word", "n"))):
            if key != now:
                if speller:
                    yield from answered()
                now, words, counts, speller, waiting, size = key, [], [], None, {}, 0
            data = word.encode("latin-1")
            if role == 0:
                words.append(data)
                counts.append(n)
            elif words:  # without words in the tree nothing is near
                speller = speller or Speller(words, counts)
                waiting.setdefault(len(data), []).append(data)
                size += len(data)
                if size >= BATCH:
                    yield from answered()
                    waiting, size = {}, 0
    if speller:
        yield from answered()


def occurrences(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """word, n of every run of letters. noise: a prime; a run whose crc32 with its doc_id it divides loses the code point at crc32 modulo length."""
    lowered = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if noise:
        h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
        at = F.pmod(h, F.length("run").cast("long")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(h % noise == 0, cut).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def near_words(spark: SparkSession, words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, best (less: minus its count, word) for the words (word, n; stored) that have near ones."""
    buckets = max(1, words.count() // shard_words)
    m, sides = F.length("word"), []
    for side in (0, 1):
        for role, more in ((0, 0), (1, -1), (1, 0), (1, 1)):
            length = m + more
            # the half of the tree's words that the edit spares, as it stands in this word
            half = F.substring(F.col("word"), F.lit(1), F.floor(length / 2).cast("int")) if side == 0 else F.right("word", (length - F.floor(length / 2)).cast("int"))
            sides.append(F.struct(length.alias("len"), F.lit(side).alias("side"), F.pmod(F.xxhash64(half), F.lit(buckets)).alias("bucket"), F.lit(role).alias("role")))
    rows = words.select("word", "n", F.explode(F.array(*sides)).alias("at")).select("at.*", "word", "n").where("len > 0")
    tree = ["len", "side", "bucket"]
    sizes = rows.where("role = 0").groupBy(*tree).agg(F.ceil(F.count("*") / (2 * shard_words)).cast("long").alias("slices"))
    slices = F.expr("CASE role WHEN 0 THEN array(pmod(xxhash64(word), slices)) ELSE sequence(0L, slices - 1) END")
    dealt = rows.join(sizes, tree).select(*tree, F.explode(slices).alias("slice"), "role", "word", "n")  # queries without a tree go here
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [*tree, "slice"]
    found = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "role").mapInArrow(_answers, _FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(spark: SparkSession, words: DataFrame, ratio: int = 5, shard_words: int = SHARD_WORDS, rounds: int = 40) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n; distinct words of letters up to U+00FF)."""
    words = stored(spark, words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    found = near_words(spark, words, shard_words)
    named = words.join(found, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.word")).alias("form"), "form_n")
    named = stored(spark, named, "spelling-forms")
    up = stored(spark, named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):  # each round doubles the steps that a root is away
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = stored(spark, up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(spark, up)
        up = stepped.select("word", "root")
        up.stored_at = stepped.stored_at
        if stepped.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"roots did not settle in {rounds} rounds")
    return named.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(spark: SparkSession, docs: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, noise: int | None = None) -> DataFrame:
    """The variants of the words of documents (doc_id, text)."""
    words = occurrences(docs, noise).where((F.length("word") >= least_chars) & (F.col("n") >= least_n))
    return variants(spark, words, ratio)
