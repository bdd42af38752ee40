"""WARC archives: a writer with payload deduplication and a splittable reader.

Writer: each record is one gzip member. Of records with equal payloads of at least MIN_REVISIT bytes,
the one with the smallest page_id is a response and the others are revisit records that refer to it;
smaller payloads are all responses. Tasks write files of about ROLL bytes, under names of their own
attempt, and report them; only files that a successful attempt reported are read, so a lost executor or
a second attempt leaves nothing but files that nobody reads.

Reader: archives are dealt out as byte ranges. A task scans its range for the gzip magic, accepts a
candidate only if it decodes and begins with a WARC version line, and owns the records that start
inside its range; the last one is read to its end beyond it. A range is read in pieces, so memory is
bounded by a piece and one record. Archives of other writers are read too: all record types, header names in any
case, folded header lines, records without digest or HTTP length, chunked bodies; digests that a record gives as SHA-1, SHA-256
or MD5, in hex or base 32, are checked. Each record must be a gzip member of its own, as the format recommends.

Which payloads repeat is found on (digest, page_id) alone, pre-aggregated before the shuffle; one
payload in a third of all pages is one key of a join that adaptive execution may split.

Null html is an empty payload; null url leaves the target out; a null page_id never is the smallest.
Rows that repeat a page_id with its payload are all responses. Very long payloads are one record, in memory once. Empty tables
write no file and read none. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

MIN_REVISIT = 100
ROLL, SPLIT, PIECE = 64 << 20, 4 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE, refers_url: str | None = None) -> bytes:
    """One WARC 1.1 record, not compressed. refers_to: the response that a revisit repeats."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = b"\r\n".join(http) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    target = lambda x: x.replace("\r", "%0D").replace("\n", "%0A").strip(" \t")  # noqa: E731  a header line can't hold line ends
    if url is not None:
        head.append(f"WARC-Target-URI: {target(url)}")
        if target(url) != url:
            head.append(f"X-Target-URI-Encoded: {urllib.parse.quote(url, errors='surrogatepass')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {target(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: corpusmill\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_HEAD_END = re.compile(rb"\r?\n\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")


def _headers(data: bytes) -> dict[str, str]:
    """Header lines behind the first, by lower-case name, the first of each; folded lines are joined."""
    out: dict[str, str] = {}
    for line in _FOLD.sub(" ", data.decode("utf-8", "surrogateescape")).splitlines()[1:] if b"\n" in data else []:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _split(data: bytes) -> tuple[bytes, bytes]:
    """A head and what follows the empty line behind it."""
    at = _HEAD_END.search(data)
    return (data[: at.start()], data[at.end() :]) if at else (data, b"")


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together; as it is where it isn't chunked after all."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\n", at)
        size = body[at : end if end >= 0 else len(body)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(out)


def _agrees(digest: str, *payloads: bytes) -> bool:
    """One of the payloads has the digest; true for kinds of digest that aren't known here."""
    kind, _, value = digest.partition(":")
    if kind.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    for payload in payloads:
        found = hashlib.new(kind.lower().replace("-", ""), payload)
        if value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("="):
            return True
    return False


def parse(data: bytes) -> tuple:
    """A record's RECORD row; checks lengths and, where there is one, the payload's digest.

    The payload of HTTP records is the body, of others the block. payload_digest is the payload's SHA-256, or what
    a record without payload says of it.
    """
    head, rest = _split(data)
    fields = _headers(head)
    kind = fields.get("warc-type", "").lower()
    length = fields.get("content-length", "")
    if length.isdigit():
        block = rest[: int(length)]
        if len(block) != int(length) or rest[int(length) :].strip(b"\r\n"):
            raise ValueError("a record's length is wrong")
    else:
        block = rest.removesuffix(b"\r\n\r\n")
    given = fields.get("warc-payload-digest", "")
    payload: bytes | None = block
    size = len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        top, payload = _split(block)
        http = _headers(top)
        raw = payload
        if "chunked" in http.get("transfer-encoding", "").lower():
            payload = _unchunked(payload)
        size = len(payload)
        if kind == "response" and given.startswith("sha256:") and fields.get("x-page-id") and http.get("content-length", str(size)) != str(size):
            raise ValueError("a payload's length is wrong")
        if kind == "revisit":
            size = int(said) if (said := http.get("content-length", "")).isdigit() else None
        elif given and not _agrees(given, payload, raw):
            raise ValueError("a payload differs from its digest")
    if kind == "revisit":
        payload, digest = None, given.removeprefix("sha256:") or None
    else:
        digest = hashlib.sha256(payload).hexdigest()
    page, refers, url = fields.get("x-page-id"), fields.get("x-refers-to-page-id"), fields.get("warc-target-uri")
    if (exact := fields.get("x-target-uri-encoded")) is not None:
        url = urllib.parse.unquote(exact, errors="surrogatepass")
    elif url is not None and url.startswith("<") and url.endswith(">"):
        url = url[1:-1]
    number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None
    return (number(page), url, size, digest, kind, number(refers), payload)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisited(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages with digest and refers_to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"))
    counted = pages.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    firsts = stored(spark, counted.where("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "payloads")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(None)).otherwise(F.col("first_id"))
    return pages.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_url"))


def write(spark: SparkSession, pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write archives under folder (a URI that every executor sees); returns file, size, records, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        attempt, out, name, size, count, made = TaskContext.get().taskAttemptId(), None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, size, count))
                out = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers, refers_url = (c[i].as_py() for c in columns)
                member = _member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, refers_url=refers_url))
                if out is None:
                    name, size, count = f"pages-{attempt:08d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(first := _member(info(name)))
                    size = len(first)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= roll:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in made]), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64())], ["file", "size", "records"])

    return stored(spark, revisited(spark, pages).mapInArrow(run, "file string, size long, records long"), "archives")


class Range:
    """Records that start in [start, end) of an open file."""

    def __init__(self, source, start: int, end: int, piece: int = PIECE):
        self.source, self.start, self.end, self.piece = source, start, end, piece
        self.size = source.size()
        self.at, self.buffer = start, b""  # buffer begins at offset `at`

    def _fill(self, offset: int, n: int) -> bytes:
        """Bytes [offset, offset + n), less at the end of the file."""
        low, high = offset - self.at, min(offset + n, self.size) - self.at
        if low < 0 or high > len(self.buffer):
            self.source.seek(offset)
            self.at, self.buffer = offset, self.source.read(max(n, self.piece))
            low, high = 0, min(n, len(self.buffer))
        return self.buffer[low:high]

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """The member at an offset and the offset behind it; None if none is there."""
        head = self._fill(offset, 512)
        try:
            if not zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/1."):
                return None
            unpack, parts, at = zlib.decompressobj(31), [], offset
            while not unpack.eof:
                data = self._fill(at, 65_536)
                if not data:
                    return None
                parts.append(unpack.decompress(data))
                at += len(data)
        except zlib.error:
            return None
        return b"".join(parts), at - len(unpack.unused_data)

    def __iter__(self) -> Iterator[bytes]:
        at = self.start
        while at < min(self.end, self.size):
            window = self._fill(at, 65_536)
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += found
            if at >= self.end:
                return
            got = self.member(at)
            if got is None:
                at += 1
            else:
                yield got[0]
                at = got[1]


def read(spark: SparkSession, files: DataFrame, split: int = SPLIT, payloads: bool = True, types: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """RECORD rows of all archives in files(file, size), of these types (none named: of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, path = pyarrow.fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for data in Range(source, start, end):
                        row = parse(data)
                        if types and row[4] not in types:
                            continue
                        rows.append(row if payloads else row[:-1])
                        held += len(data) if payloads else 100
                        if held > 4 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = files.where("size > 0").select("file", starts.alias("start")).withColumn("end", F.col("start") + split)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return ranges.repartition(parts, "file", "start").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write all pages and read the archives back."""
    return read(spark, write(spark, pages, folder or scratch(spark, "warc")), payloads=payloads)
