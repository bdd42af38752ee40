"""Benchmark decontamination by the q-gram lemma.

Items are cut into segments of SEGMENT characters, one begun every STRIDE, so a passage of SEGMENT + STRIDE - 1 = 95
characters of an item holds a whole segment wherever it is cut. A region of a document holds a
segment of m characters with at most k edits only if both share m + 1 - q - k * q q-grams, all on
diagonals at most k apart. So shared q-grams are counted in diagonal bands of width 2w, w > k, that
overlap by w (every spread of k lies within one band); bands that reach the bound are verified by
banded alignment. Nothing else is aligned, and no region within the edit budget is missed. Segments that
several items share (a common prompt) are searched once.

Texts are compared with ASCII letters lowered and white space as single spaces; positions refer to the
text itself. Items under MIN_CHARS such characters are one segment without edits that must stand between
characters that aren't letters or digits; those under q characters must be the whole text.

Documents are the large side and are read once for each block of items, without a shuffle; a block is at
most BLOCK_CHARS of benchmark text (or one item), and a larger benchmark takes more blocks. Items reach tasks as Spark
broadcasts, which the driver keeps in files; a Python worker indexes a block once. Postings are read
in pieces of PIECE, so memory follows the longest text, and not how often a q-gram occurs.

Null and empty texts match nothing, null and blank items are left out; rows without doc_id and repeated rows are
searched like others. An empty benchmark or table gives an empty result. Other columns play no part in
contamination and stay as they are in clean, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

Q, SEGMENT, STRIDE, MIN_CHARS, BUDGET = 8, 80, 16, 24, 0.1
BLOCK_CHARS, PIECE = 2_000_000, 2_000_000
TABLE_BITS = 22
HIT = "doc_id long, item_id long, start long, end long, edits int"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FAR, NOTHING = 1 << 13, 0xFFFFFFFF
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32


def normal(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points to compare, and where in the text each stands."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _LOWER[codes & 127], codes)
    space = codes == 32
    again = space[1:] & space[:-1]
    if not again.any():
        return codes, np.arange(len(codes))
    at = np.flatnonzero(np.append(True, ~again))
    return codes[at], at


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit value of every q-gram, a polynomial put together from its halves."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    base = int(_MULTIPLIER)
    out, size = codes.astype(np.uint64) + np.uint64(1), 1
    parts = out
    for bit in bin(q)[3:]:
        out = out[: len(out) - size] * np.uint64(pow(base, size, 1 << 64)) + out[size:]
        size *= 2
        if bit == "1":
            out = out[: len(out) - 1] * _MULTIPLIER + parts[size:]
            size += 1
    return out ^ (out >> np.uint64(29))


def _slot(values: np.ndarray) -> np.ndarray:
    return ((values * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def banded_edits(patterns: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern in its region, and the diagonal on which that alignment ends.

    patterns: (n, m) characters. regions: (n, m + width - 1) characters, NOTHING where there is no text.
    Cell (i, j) aligns i pattern and i + j region characters, on diagonal j < width; text before and after
    the match is free. A place without text matches nothing, which costs what leaving the pattern's
    character out costs.
    """
    n, m = patterns.shape
    width = regions.shape[1] - m + 1
    j = np.arange(width, dtype=np.int16)
    row = np.zeros((n, width), np.int16)
    drop = np.full((n, width), FAR, np.int16)
    for i in range(m):
        drop[:, :-1] = row[:, 1:]
        row += regions[:, i : i + width] != patterns[:, i, None]
        np.minimum(row, drop + 1, out=row)
        np.minimum.accumulate(row - j, axis=1, out=row)
        row += j
    end = row.argmin(axis=1)
    return row[np.arange(n), end], end


class Block:
    """A q-gram index of some items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, segment: int = SEGMENT, budget: float = BUDGET, stride: int = STRIDE):
        self.q, self.segments, values, owner, offset = q, [], [], [], []
        self.tiny: dict[bytes, list[int]] = {}
        at: dict[tuple[bytes, bool], int] = {}
        self.items: list[list[int]] = []  # of each segment
        for item_id, text in items:
            codes = _stripped(normal(text)[0])
            if not len(codes):
                continue
            if len(codes) < q:
                self.tiny.setdefault(codes.astype(np.uint32).tobytes(), []).append(item_id)
                continue
            m, short = min(segment, len(codes)), len(codes) < MIN_CHARS
            for s in sorted({*range(0, len(codes) - m + 1, stride), len(codes) - m}):
                own = codes[s : s + m].astype(np.uint32)
                if (known := at.get((own.tobytes(), short))) is not None:
                    if self.items[known][-1] != item_id:
                        self.items[known].append(item_id)
                    continue
                at[own.tobytes(), short] = len(self.segments)
                k = 0 if short else int(budget * m)
                while m + 1 - q - k * q < 1:
                    k -= 1
                found = grams(own, q)
                values.append(found)
                owner.append(np.full(len(found), len(self.segments), np.int32))
                offset.append(np.arange(len(found), dtype=np.int32))
                self.items.append([item_id])
                self.segments.append((own, k, m + 1 - q - k * q, short))
        self.values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(self.values, kind="stable")
        self.values = self.values[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int32))[order]
        self.offset = (np.concatenate(offset) if offset else np.zeros(0, np.int32))[order]
        self.distinct, self.first, self.many = np.unique(self.values, return_index=True, return_counts=True)
        slots = _slot(self.distinct)
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[slots] = True
        # a slot's value by its index; slots that values share are searched for instead
        self.index = np.zeros(1 << TABLE_BITS, np.int32)
        self.index[slots] = np.arange(len(slots))
        self.crowded = np.zeros(1 << TABLE_BITS, bool)
        found, times = np.unique(slots, return_counts=True)
        self.crowded[found[times > 1]] = True
        self.need = np.array([s[2] for s in self.segments], np.int64)
        self.least = int(self.need.min()) if len(self.need) else 0
        self.band = np.array([s[1] + 1 for s in self.segments], np.int64)

    def _postings(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of at, posting) for all postings of the q-grams at, in pieces."""
        n = self.many[at]
        ends = np.cumsum(n)
        begin = 0
        while begin < len(at):
            end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE, "right")), begin + 1)
            low, m = self.first[at[begin:end]], n[begin:end]
            yield np.repeat(np.arange(begin, end), m), np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m - low, m)
            begin = end

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(segment, first diagonal of the band) for every band with as many distinct q-grams of the segment as a match needs."""
        have = grams(codes, self.q)
        slots = _slot(have)
        where = np.flatnonzero(self.known[slots])
        values, slots = have[where], slots[where]
        at = self.index[slots].astype(np.int64)
        if len(shared := np.flatnonzero(self.crowded[slots])):
            at[shared] = np.minimum(np.searchsorted(self.distinct, values[shared]), len(self.distinct) - 1)
        real = self.distinct[at] == values if len(at) else np.zeros(0, bool)
        where, at = where[real], at[real]
        if not len(at):
            return []
        # a band can't have more of a segment's q-grams than the whole text: each q-gram of the text is looked at once here
        if len(at) < self.least:
            return []
        distinct, times = np.unique(at, return_counts=True)
        counts = np.zeros(len(self.segments), np.int64)
        for _, posting in self._postings(distinct):
            counts += np.bincount(self.owner[posting], minlength=len(self.segments))
        able = counts >= self.need
        if not able.any():
            return []
        pairs = np.zeros(len(self.segments))
        for which, posting in self._postings(distinct):
            pairs += np.bincount(self.owner[posting], times[which], minlength=len(self.segments))
        # segments in groups of bounded pairs of a place and a posting
        group = np.where(able, np.cumsum(np.where(able, pairs, 0)) // PIECE, -1)
        out: list[tuple[int, int]] = []
        for now in np.unique(group[able]):
            out += self._bands(where, at, len(codes), group == now)
        return out

    def _bands(self, where: np.ndarray, at: np.ndarray, n_codes: int, wanted: np.ndarray) -> list[tuple[int, int]]:
        """The candidates among the wanted segments, from the q-grams at with their places."""
        span = n_codes + 2 * SEGMENT + 8
        held = []
        for which, posting in self._postings(at):
            segment = self.owner[posting]
            likely = wanted[segment]
            if not likely.any():
                continue
            segment, offset = segment[likely].astype(np.int64), self.offset[posting[likely]].astype(np.int64)
            band = (where[which[likely]] - offset) // self.band[segment]  # band b covers diagonals [b * w, (b + 2) * w)
            key = (segment * span + band + SEGMENT + 2) * SEGMENT + offset
            held += [key, key - SEGMENT]
        # a q-gram of the segment counts once in a band, however often a repetitive text has it
        keys = np.sort(np.concatenate(held))
        keys = keys[np.append(True, keys[1:] != keys[:-1])] // SEGMENT
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        owners = keys // span
        enough = counts >= self.need[owners]
        owners, bands = owners[enough], keys[enough] % span - SEGMENT - 2
        return list(zip(owners.tolist(), (bands * self.band[owners]).tolist()))

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, start, end, edits) of each text: for each item its verified regions, merged where they touch."""
        out: list[list[tuple[int, int, int, int]]] = []
        for i in range(0, len(texts), 256):  # the candidates of some texts are aligned together
            out += self._search(texts[i : i + 256])
        return out

    def _search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        read = [normal(t) for t in texts]
        found: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in texts]
        todo: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        waiting = 0
        for i, (codes, places) in enumerate(read):
            if self.tiny and len(whole := _stripped(codes)) < self.q:
                for item_id in self.tiny.get(whole.astype(np.uint32).tobytes(), ()):
                    found[i].setdefault(item_id, []).append((int(places[lead := int(codes[0] == 32)]), int(places[lead + len(whole) - 1]) + 1, 0))
            for s, shift in self.candidates(codes) if self.segments else ():
                todo.setdefault((len(self.segments[s][0]), self.segments[s][1]), []).append((i, s, shift))
                waiting += 1
            if waiting > 65_536:
                self._verify(read, todo, found)
                todo, waiting = {}, 0
        self._verify(read, todo, found)
        return [merged(x) for x in found]

    def _verify(self, read: list, todo: dict, found: list) -> None:
        """Align the candidates and note those within their budget, for every item that has the segment."""
        for (m, k), rows in todo.items():
            # the alignment's diagonals may leave those of its q-grams by k at either side
            width = 2 * (k + 1) + 2 * k
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                regions = np.full((len(part), m + width - 1), NOTHING, np.uint32)
                for r, (i, _, shift) in zip(regions, part):
                    codes, begin = read[i][0], shift - k
                    piece = codes[max(0, begin) : max(0, begin + len(r))]
                    r[max(0, -begin) : max(0, -begin) + len(piece)] = piece
                edits, ends = banded_edits(np.stack([self.segments[s][0] for _, s, _ in part]), regions)
                for (i, s, shift), e, j in zip(part, edits.tolist(), ends.tolist()):
                    if e <= k:
                        codes, places = read[i]
                        end = shift - k + m + j
                        begin = max(0, end - m - (k - e if e else 0))
                        if self.segments[s][3] and not (_bounded(codes, begin - 1) and _bounded(codes, end)):
                            continue
                        region = (int(places[begin]), int(places[max(0, min(end, len(places)) - 1)]) + 1, e)
                        for item_id in self.items[s]:
                            found[i].setdefault(item_id, []).append(region)


def _stripped(codes: np.ndarray) -> np.ndarray:
    """Without the space at either end that normal() leaves."""
    a = 1 if len(codes) and codes[0] == 32 else 0
    return codes[a : len(codes) - 1 if len(codes) > a and codes[-1] == 32 else len(codes)]


def _bounded(codes: np.ndarray, at: int) -> bool:
    """No letter or digit stands there."""
    return not 0 <= at < len(codes) or not chr(codes[at]).isalnum()


def merged(found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, int]]:
    """Regions of each item, joined where they touch, with the most edits of any of their segments."""
    out = []
    for item_id, regions in sorted(found.items()):
        last: list[int] = []
        for start, end, edits in sorted(regions):
            if last and start <= last[1]:
                last[1:] = [max(last[1], end), max(last[2], edits)]
            else:
                if last:
                    out.append((item_id, *last))
                last = [start, end, edits]
        out.append((item_id, *last))
    return out


def blocks(spark: SparkSession, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[str, Broadcast]]:
    """The benchmark's items in pieces of bounded size, one in the driver's memory at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if held and size + len(row.text) > block_chars:
            yield uuid.uuid4().hex, spark.sparkContext.broadcast(held)
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(held)


#: The block this Python worker indexed last: tasks of one worker mostly search the same one.
_LAST: dict[str, Block] = {}


def _indexed(key: str, items: Broadcast) -> Block:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Block(items.value)
    return _LAST[key]


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """HIT rows: each region of a document that holds part of an item; clean documents have none."""
    out = spark.createDataFrame([], HIT)
    for key, items in blocks(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], key: str = key, items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            block = _indexed(key, items)
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, hits in zip(batch.column(0).to_pylist(), block.search(batch.column(1).to_pylist())) for hit in hits]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "start", "end", "edits"])

        out = out.union(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, HIT))
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no region of any item, with their own columns."""
    for key, items in blocks(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], key: str = key, items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            block = _indexed(key, items)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not hits for hits in block.search(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
