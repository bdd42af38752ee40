import gzip
import hashlib
import io

import pytest

from corpusmill.llm import warc as A


class Source:
    def __init__(self, data):
        self.file, self.n = io.BytesIO(data), len(data)

    def size(self):
        return self.n

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        return self.file.read(n)


def archive(payloads):
    return b"".join(A._member(A.record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(payloads))


def test_every_split_owns_each_record_once():
    payloads = [b"x%d " % i * (i * 37 % 400) for i in range(30)]
    data = archive(payloads)
    for split in (1, 13, 100, 1000, len(data), 10 * len(data)):
        got = [A.parse(r) for at in range(0, len(data), split) for r in A.Range(Source(data), at, at + split, piece=300)]
        assert [g[0] for g in got] == list(range(30)) and [g[-1] for g in got] == payloads


def test_false_magic_is_passed_over():
    data = archive([b"first"]) + A.MAGIC + b"noise" + A.MAGIC + gzip.compress(b"not a record") + archive([b"second"])
    assert [A.parse(r)[-1] for r in A.Range(Source(data), 0, len(data))] == [b"first", b"second"]


def test_a_spoiled_payload_is_noticed():
    bad = A.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        A.parse(bad)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = spark.createDataFrame([(900, "http://a/\r\nb%", "same payload " * 20), (901, None, "same payload " * 20), (902, "http://c", "tiny"), (903, "http://c", "tiny"), (904, "u", None), (905, "u", ""), (906, "u", "é\U0001f600" * 50_000)], "page_id long, url string, html string")
    pages = pages.unionByName(more)
    files = A.write(spark, pages, A.scratch(spark, "warc-test"), roll=20_000)
    assert files.count() > 3
    want = {r.page_id: ((r.html or "").encode(), r.url) for r in pages.collect()}
    for split in (5_000, 1 << 22):
        rows = A.read(spark, files, split=split).collect()
        assert sorted(r.page_id for r in rows) == sorted(want)
        response = {r.page_id: r for r in rows if r.record_type == "response"}
        for r in rows:
            payload, url = want[r.page_id]
            assert (r.payload_bytes, r.payload_digest, r.url) == (len(payload), hashlib.sha256(payload).hexdigest(), url)
            if r.record_type == "response":
                assert bytes(r.payload) == payload and r.refers_to is None
            else:
                assert r.refers_to < r.page_id and bytes(response[r.refers_to].payload) == payload
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds[901] == ("revisit", 900) and kinds[903] == ("response", None) and kinds[905] == ("response", None)


def test_odd_rows(spark):
    rows = [(None, "u", "x" * 200), (1, "u", "x" * 200), (2, None, "x" * 200), (2, None, "x" * 200), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in A.round_trip(spark, pages).collect())
    assert got == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1)]
    assert A.round_trip(spark, pages.where("false")).count() == 0


def foreign():
    """Records as other writers make them, with the rows they must give."""
    sha1 = lambda x: __import__("base64").b32encode(hashlib.sha1(x).digest()).decode()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    body, chunked = b"<p>body</p>", b"5\r\n<p>bo\r\n6;x=1\r\ndy</p>\r\n0\r\n\r\n"
    http = lambda more, payload: b"HTTP/1.1 200 OK\r\nServer: x\r\n" + more + b"\r\n" + payload

    def make(kind, block, *more, end="\r\n", length=True):
        head = ["WARC/1.0", f"WARC-Type: {kind}", *more] + ([f"content-length: {len(block)}"] if length else [])
        return (end.join(head) + end + end).encode() + block + b"\r\n\r\n"

    web = "Content-Type: application/http; msgtype=response"
    return [
        (make("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Filename: a.warc.gz"), (None, None, 13, sha(b"software: x\r\n"), "warcinfo", None, b"software: x\r\n")),
        (make("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/b%20c"), (None, "http://a/b%20c", 0, sha(b""), "request", None, b"")),
        (make("response", http(b"", body), web, "warc-target-uri: http://a/b%20c", f"WARC-Payload-Digest: sha1:{sha1(body)}"), (None, "http://a/b%20c", 11, sha(body), "response", None, body)),
        (make("response", http(b"Transfer-Encoding: chunked\r\n", chunked), web, "WARC-Target-URI: <http://a/>"), (None, "http://a/", 11, sha(body), "response", None, body)),
        (make("response", http(b"Content-Length: 99\r\n", body), web, "X-Long: one\r\n\t two", "WARC-Payload-Digest: sha512:what"), (None, None, 11, sha(body), "response", None, body)),
        (make("resource", body, "Content-Type: text/html", end="\n"), (None, None, 11, sha(body), "resource", None, body)),
        (make("metadata", b"outlink: x", "Content-Type: application/warc-fields", length=False), (None, None, 10, sha(b"outlink: x"), "metadata", None, b"outlink: x")),
        (make("revisit", b"", "WARC-Refers-To: <urn:uuid:1>", f"WARC-Payload-Digest: sha1:{sha1(body)}"), (None, None, 0, f"sha1:{sha1(body)}", "revisit", None, None)),
    ]


def test_archives_of_other_writers(spark, tmp_path):
    for data, want in foreign():
        assert A.parse(data) == want
    data = b"".join(gzip.compress(d) for d, _ in foreign())
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "file string, size long")
    for split in (7, 200, 1 << 22):
        rows = A.read(spark, files, split=split, types=()).collect()
        assert sorted(map(repr, (tuple(r[:-1]) for r in rows))) == sorted(repr(w[:-1]) for _, w in foreign()), split
    assert {r.record_type for r in A.read(spark, files).collect()} == {"response", "revisit"}


def test_uris_are_written_as_they_are():
    data = A.record(1, "http://a/b%20c?q=%C3%A9", b"x", hashlib.sha256(b"x").hexdigest(), None)
    assert b"WARC-Target-URI: http://a/b%20c?q=%C3%A9\r\n" in data and A.parse(data)[1] == "http://a/b%20c?q=%C3%A9"
    again = A.record(2, "u", b"x", "d", 1, refers_url="http://a/b%20c")
    assert b"WARC-Refers-To-Target-URI: http://a/b%20c\r\n" in again and b"WARC-Refers-To-Date: " in again
