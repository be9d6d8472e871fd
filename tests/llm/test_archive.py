import gzip
import hashlib

import llm_cases
import pytest

from gridtide.llm import archive, queries

SF = "/root/testdata/sf0.01"


def expected(rows, least=1000):
    """page_id, payload bytes, digest, type, refers_to by the definition."""
    payloads = [(page, (text or "").encode()) for page, text in rows]
    largest = {}
    for page, payload in payloads:
        if page is not None and len(payload) >= least:
            largest[payload] = max(page, largest.get(payload, page))
    out = []
    for page, payload in payloads:
        holder = largest.get(payload)
        revisit = holder is not None and page != holder
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=repr)


def found(frame):
    rows = frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=repr)


def test_awkward_pages_round_trip(spark):
    long = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 100 + "é日\x00\x85"
    rows = [
        (1, "http://a/ b", None), (2, "http://x\r\nWARC-Type: evil", ""), (3, "u", long), (9, None, long), (5, "u5", long), (6, "u", "short"),
        (7, "u", "short"), (8, "u", "x" * 1000), (10, "u", "x" * 1000), (10, "u", "x" * 1000), (11, "u", "x" * 999), (None, "u", "x" * 1000), (None, "n", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'x' AS value", "1 AS holder")
    frame = archive.archive_round_trip(pages)
    assert found(frame) == expected([(page, text) for page, _, text in rows])
    urls = sorted(((row.page_id, row.url) for row in frame.collect()), key=repr)
    assert urls == sorted(((page, url) for page, url, _ in rows), key=repr)
    assert all(row.payload_verified == row.payload_digest for row in frame.collect() if row.record_type == "response")
    assert archive.archive_round_trip(pages.limit(0)).count() == 0


def record(kind, identifier, block, *headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives_are_assembled(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    media = "Content-Type: application/http; msgtype=response"
    parts = [
        record("warcinfo", "w", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "warc-concurrent-to: <r1>", "Content-Type: application/http; msgtype=request"),
        record("response", "r1", http, media),
        record("metadata", "m1", b"via: z\r\n", "WARC-Concurrent-To: <r1>", "Content-Type: application/warc-fields"),
        record("request", "q2", b"GET /2 HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", "r2", http, "WARC-Concurrent-To: <q2>", media),
        record("response", "r3", http, media),
        record("request", "q4", b"late", "WARC-Concurrent-To: <r1>"),
        record("request", "q5", b"orphan", "WARC-Concurrent-To: <gone>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(part) for part in parts[:5]))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[5:]))
    rows = {row.record_id: row for row in archive.assemble(archive.read_archives(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r1>", "<r2>", "<r3>"}
    assert rows["<r1>"].request.record_id == "<q1>" and rows["<r1>"].metadata.fields == {"via": "z"} and bytes(rows["<r1>"].payload) == b"body"
    assert rows["<r2>"].request.record_id == "<q2>" and rows["<r2>"].metadata is None
    assert rows["<r3>"].request is None


def test_cut_archives_raise():
    whole = record("response", "r", b"0123456789")
    assert len(list(archive.parse_archive([whole[:20], whole[20:]]))) == 1
    for size in (10, len(whole) - 8):
        with pytest.raises(ValueError):
            list(archive.parse_archive([whole[:size]]))


def test_query_equals_the_definition(spark):
    pages = llm_cases.read(SF, "SELECT page_id, html FROM pages")
    assert found(queries.QUERIES["op1_warc_transactions"](spark, SF)) == expected(pages)
