"""Substring dedup with a log-structured index of window hashes.

A window is WINDOW consecutive words of one document. Words covered by a window whose words also
start in a document with a smaller doc_id are removed; windows are judged on the input.

The index is a folder with a manifest and immutable runs, each bucketed and sorted by window hash. A batch
of documents is merge-joined with the runs, bucket by bucket, on two independent hashes (a rolling 64-bit hash
that finds, and 64 bits of BLAKE2b over the window's own words that verify; among 10^13 windows, 100 TB of
text, two different ones agree on both with probability below 10^-12). Windows it brings first become a new run, and
when there are more than FAN_OUT runs they are compacted into one, bucket by bucket. Only the batch is
shuffled: what history holds stays where it lies. A run counts once the manifest that names it is in place, so a
job that dies half-way leaves files that nobody reads.

deduplicate(index=WindowIndex(spark, folder)) adds to an index that lasts: windows in history count as repeated, and the next
call goes on from there. Such an index holds every window, 16 bytes a word before compression. Without
one, a call deals its own documents into BATCHES in order of doc_id, so what an earlier batch holds comes from
smaller ids. No later batch will come, so windows that can't repeat are left out: a window can only repeat if
its anchor does, the GRAM-word hash that is least among those inside the window, the same wherever the
window stands. A first pass counts anchors over all documents (about one for 13 words), and only windows whose
anchor occurs in two documents reach the index. That drops nothing: two equal windows have equal anchors.

Copies collapse first: of documents with one text the smallest doc_id stands for all, the others lose every
word if the text has a window at all, and bring nothing to the index.

Scale: anchors and windows are counted with partial aggregation before the shuffle and joined back by
sort-merge joins that adaptive execution may split, so a passage in a third of all documents is a
skewed join, not one task. No pairs are made: each window meets its first owner only. Texts are
shuffled twice at most, by doc_id. State between steps is Parquet in the shared folder.

Null and empty texts have no words. Rows without doc_id are compared with nothing and keep all words.
Texts under WINDOW words have no window; very long ones are read whole. Rows that share a doc_id, repeated or
with different texts, are no smaller than each other; each loses only words of its own. Empty tables give empty
results. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.storage import file_system

from .common import discard, release, remove, scratch, stored, words_of

WINDOW, GRAM = 50, 25
BATCHES, FAN_OUT = 4, 2
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power("up", _BASE, n), out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * _power("down", _INVERSE, n - k + 1))


def encoded(words: list[str]) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in words]


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def window_anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For every window start the hash of its anchor."""
    grams = rolling(hashes, gram)
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    span = window - gram + 1
    out = np.empty(len(hashes) - window + 1, np.uint64)
    for at in range(0, len(out), 65_536):  # bounded memory for very long texts
        end = min(at + 65_536, len(out))
        out[at:end] = np.lib.stride_tricks.sliding_window_view(grams[at : end + span - 1], span).min(axis=1)
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owners, rows = [], [], []
        for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
            words = words_of(text)
            if len(words) >= WINDOW:
                own = np.unique(window_anchors(word_hashes(encoded(words))))
                found.append(own.view(np.int64))
                owners.append(np.full(len(own), doc_id, np.int64))
                rows.append(np.full(len(own), row, np.int64))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, owners, rows)], ["anchor", "doc_id", "row_key"])


def anchors(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "row_key", "text").mapInArrow(_anchors, "anchor long, doc_id long, row_key long")


def keyed_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, row_key, text: row_key is 0 but where a doc_id repeats; there it is a hash of the text, so that rows stay apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("twice"))
    twice = stored(spark, twice, "repeated-ids")
    if twice.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("row_key"), "text")
    return docs.join(twice, "doc_id", "left").select("doc_id", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0)).alias("row_key"), "text")


def copies_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, row_key of every document whose text a smaller doc_id has."""
    digests = stored(spark, docs.where("text IS NOT NULL").select("doc_id", "row_key", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # stored, so that both sides of the join come straight from a shuffle and a text with very many copies can be split
    firsts = stored(spark, firsts.select("digest", "low"), "copied-digests")
    copies = stored(spark, digests.join(firsts, "digest").where("doc_id > low").select("doc_id", "row_key").distinct(), "copies")
    discard(spark, digests, firsts)
    return copies


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h", "proof", "doc_id", "row_key", "start"]
    for batch in batches:
        held, rows = [], 0
        for doc_id, row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text")), batch.column("anchors")):
            words = encoded(words_of(text))
            if len(words) < WINDOW:
                continue
            hashes = word_hashes(words)
            if wanted.is_valid:
                starts = np.flatnonzero(np.isin(window_anchors(hashes).view(np.int64), wanted.values.to_numpy()))
            else:
                starts = np.arange(len(words) - WINDOW + 1)
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            whole = rolling(hashes, WINDOW)
            for at in range(0, len(starts), 100_000):  # a very long text in pieces
                some = starts[at : at + 100_000]
                spans = zip(begins[some].tolist(), ends[some + WINDOW - 1].tolist())
                proof = np.frombuffer(b"".join(hashlib.blake2b(joined[a:b], digest_size=8).digest() for a, b in spans), np.int64)
                held.append((whole[some].view(np.int64), proof, np.full(len(some), doc_id, np.int64), np.full(len(some), row, np.int64), some.astype(np.int32)))
                rows += len(some)
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)


def windows(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(h, proof, doc_id, row_key, start) of every window, or of those whose anchor is in wanted(doc_id, row_key, anchors)."""
    docs = docs.select("doc_id", "row_key", "text")
    docs = docs.join(wanted, ["doc_id", "row_key"]) if wanted is not None else docs.withColumn("anchors", F.lit(None).cast("array<bigint>"))
    return docs.mapInArrow(_windows, "h long, proof long, doc_id long, row_key long, start int")


class WindowIndex:
    """Immutable runs of window hashes in a folder that all executors see, bucketed and sorted, named by a manifest.

    A folder that has a manifest is opened, one that has none begins an empty index.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.folder = spark, fan_out, (folder or scratch(spark, "window-index")).rstrip("/")
        self.runs: list[str] = []
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        system, root = file_system(spark, self.folder)
        system.mkdirs(root)
        names = [status.getPath().getName() for status in system.listStatus(root)]
        self.version = max((int(n.split("-")[1].split(".")[0]) for n in names if n.startswith("manifest-")), default=0)
        if self.version:
            kept = json.loads(spark.read.text(f"{self.folder}/manifest-{self.version}.json", wholetext=True).first()[0])
            self.runs, self.buckets = kept["runs"], kept["buckets"]

    def _publish(self, runs: list[str]) -> None:
        """Make these the runs of the index: the manifest appears under its name in one step."""
        self.version += 1
        system, draft = file_system(self.spark, f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}).encode()))
        out.close()
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-{self.version}.json")
        if not system.rename(draft, target):
            raise RuntimeError(f"somebody else wrote version {self.version} of the index")
        self.runs = runs

    def _write(self, rows: DataFrame) -> str:
        """A run of (h, proof): a file for each bucket."""
        name = f"window_run_{uuid.uuid4().hex}"
        dealt = rows.select("h", "proof").repartition(self.buckets, "h", "proof")
        dealt.write.bucketBy(self.buckets, "h", "proof").sortBy("h", "proof").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: the folder and its manifest are the index
        return name

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table."""
        table = f"{name}_{uuid.uuid4().hex[:6]}"
        self.spark.sql(f"CREATE TABLE {table} (h BIGINT, proof BIGINT) USING parquet CLUSTERED BY (h, proof) SORTED BY (h, proof) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        frame = self.spark.table(table)
        frame.schema  # noqa: B018  resolved before its name goes
        self.spark.sql(f"DROP TABLE {table}")
        return frame

    def owners(self, batch: DataFrame) -> DataFrame:
        """h, proof, owner and last (smallest and largest doc_id) of the batch's windows, and whether history has them."""
        found = batch.groupBy("h", "proof").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).withColumn("old", F.lit(False))
        for name in self.runs:
            known = self.run(name).withColumn("known", F.lit(True)).hint("merge")
            found = found.join(known, ["h", "proof"], "left").withColumn("old", F.col("old") | F.coalesce("known", F.lit(False))).drop("known")
        return found

    def add(self, batch: DataFrame) -> DataFrame:
        """(doc_id, row_key, start) of the batch's windows that history or a smaller doc_id of the batch holds; the rest join the index.

        batch: h, proof, doc_id, row_key, start, on storage.
        """
        owners = stored(self.spark, self.owners(batch), "window-owners")
        often = owners.where("old OR owner < last").select("h", "proof", "owner", "old")
        repeated = batch.join(often, ["h", "proof"]).where("old OR doc_id > owner").select("doc_id", "row_key", "start")
        repeated = stored(self.spark, repeated, "repeated-windows")
        self._publish([*self.runs, self._write(owners.where("NOT old"))])
        discard(self.spark, owners)
        if len(self.runs) > self.fan_out:
            self.compact()
        return repeated

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket; their keys are disjoint, as a run only gets what is in no other."""
        before, rows = self.runs, self.run(self.runs[0])
        for name in before[1:]:
            rows = rows.union(self.run(name))
        self._publish([self._write(rows)])
        for name in before:
            remove(self.spark, f"{self.folder}/{name}")

    def clear(self) -> None:
        """Delete the index: no batch will meet it again."""
        remove(self.spark, self.folder)
        self.runs = []


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, digests, texts = [], [], [], []
        for text, starts, copy in zip(batch.column("text").to_pylist(), batch.column("starts"), batch.column("copy").to_pylist()):
            words = words_of(text)
            if copy and len(words) >= WINDOW:
                kept = []
            elif starts.is_valid and len(starts.values):
                edges = np.zeros(len(words) + 1, np.int64)
                own = np.unique(starts.values.to_numpy())
                edges[own] += 1
                edges[own + WINDOW] -= 1
                stay = np.cumsum(edges[:-1]) == 0
                kept = [w for w, ok in zip(words, stay.tolist()) if ok]
            else:
                kept = words
            joined = " ".join(kept)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest())
            texts.append(joined)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def deduplicate(spark: SparkSession, docs: DataFrame, batches: int = BATCHES, index: WindowIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space) for every row.

    index: history to compare with and to add to; without one the documents are compared with each other only.
    """
    docs = keyed_rows(spark, docs)
    named = docs.where("doc_id IS NOT NULL")
    copies = copies_of(spark, named)
    if index is None:
        own, lasting = WindowIndex(spark), False
        seen = stored(spark, anchors(named).join(copies, ["doc_id", "row_key"], "left_anti"), "anchors")
        shared = stored(spark, seen.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared-anchors")
        wanted = stored(spark, seen.join(shared, "anchor").groupBy("doc_id", "row_key").agg(F.collect_set("anchor").alias("anchors")), "wanted-anchors")
        discard(spark, seen, shared)
        found, ids = windows(named, wanted), wanted
    else:
        own, lasting = index, True
        fresh = named.join(copies, ["doc_id", "row_key"], "left_anti")
        found, ids = windows(fresh), named
    marks = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [])) if batches > 1 else []
    batch_of = F.lit(0)
    for low in marks:
        batch_of = batch_of + (F.col("doc_id") > low).cast("int")
    candidates = stored(spark, found.withColumn("batch", batch_of), "windows", "batch")
    if not lasting:
        discard(spark, wanted)
    release(spark)
    repeated = []
    for i in range(len(marks) + 1):
        repeated.append(own.add(candidates.where(F.col("batch") == i).drop("batch")))
        release(spark)
    discard(spark, candidates)
    if not lasting:
        own.clear()
    found = repeated[0]
    for more in repeated[1:]:
        found = found.union(more)
    starts = found.groupBy("doc_id", "row_key").agg(F.collect_set("start").alias("starts")).withColumn("copy", F.lit(False))
    gone = copies.select("doc_id", "row_key", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    starts = stored(spark, starts.unionByName(gone), "removed-starts")
    discard(spark, copies, *repeated)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return docs.join(starts, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts", "copy").mapInArrow(_kept, schema)
