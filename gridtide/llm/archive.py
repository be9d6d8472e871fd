"""WARC archives: writing captures as transactions, and assembling transactions from archives.

Writing: every page becomes a request, a response or revisit, and a metadata record; request and metadata name the
response in WARC-Concurrent-To. A record is text with one CRLF CRLF behind it, which is what Spark's text writer
makes of a row when that is its line separator, so archives are written by executors to any store Spark can
reach. Files hold a bounded number of captures and are compressed.

Reading: files are parsed record by record from their Content-Length. Transactions are assembled by a shuffle on
the identifier that request and metadata share with their response: one aggregate brings the satellites of a
capture together, one join attaches them, and one nested row per capture comes out. Revisits find their response
through WARC-Refers-To.
"""

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage, scratch_path

CRLF = "\r\n"
REVISIT_BYTES = 1000
#: Captures in one archive file; three records each.
CAPTURES_PER_FILE = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "file string, position long, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, "
    "payload_digest string, content_length long, http_head string, payload binary, payload_bytes long, fields map<string,string>"
)


def _identifier(kind, *parts):
    """A record id made of the kind of record and a hash of what it holds."""
    digest = F.sha1(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(part.cast("string"), F.lit("\x00")) for part in parts]))
    return F.concat(F.lit("<urn:sha1:"), digest, F.lit(">"))


def _record(kind, identifier, block, *headers):
    """Record text: version line, headers without the null ones, and the block."""
    own = F.concat_ws(
        CRLF,
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), identifier),
        F.lit(f"WARC-Date: {DATE}"),
        *[F.concat(F.lit(f"{name}: "), value) for name, value in headers],
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(own, F.lit(CRLF + CRLF), block)


def with_roles(pages, revisit_bytes=REVISIT_BYTES):
    """Pages with payload digest and length, and the page that holds the payload when this one only revisits it.

    Of equal payloads of at least `revisit_bytes`, the largest page_id responds and the others revisit it. Null
    html is an empty payload. A null page_id is smaller than any other; rows that repeat the largest page_id all
    respond. The digest groups are aggregated before the join, so a group of any size costs one row per task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digested = pages.select("page_id", "url", payload.alias("html")).select(
        "*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("bytes")
    )
    groups = digested.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies"))
    shared = groups.where("copies > 1").select("digest", "holder")
    joined = digested.join(shared, "digest", "left")
    return joined.withColumn("holder", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))


def capture_records(pages, revisit_bytes=REVISIT_BYTES):
    """One row per record: the text of the record in column `value`."""
    rows = with_roles(pages, revisit_bytes)
    page, digest, holder = F.col("page_id"), F.col("digest"), F.col("holder")
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")  # a header stays one line; metadata has the url itself
    main = _identifier("response", page, digest)
    length = F.col("bytes").cast("string")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF)
    )
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    target = ("WARC-Target-URI", uri)
    digest_header = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))
    response = _record("response", main, F.concat(head, "html"), target, digest_header, http)
    refers = _identifier("response", holder, digest)
    profile = ("WARC-Profile", F.lit(PROFILE))
    revisit = _record("revisit", main, head, target, digest_header, ("WARC-Refers-To", refers), profile, http)
    request = _record(
        "request",
        _identifier("request", page, digest),
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
        target,
        ("WARC-Concurrent-To", main),
        ("Content-Type", F.lit("application/http; msgtype=request")),
    )
    note = F.concat_ws(
        CRLF,
        F.concat(F.lit("page-id: "), page.cast("string")),
        F.concat(F.lit("url-json: "), F.to_json(F.struct("url"))),
        F.lit(""),
    )
    metadata = _record(
        "metadata",
        _identifier("metadata", page, digest),
        note,
        target,
        ("WARC-Concurrent-To", main),
        ("Content-Type", F.lit("application/warc-fields")),
    )
    capture = F.when(holder.isNull(), response).otherwise(revisit)
    return rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write_archives(pages, folder, revisit_bytes=REVISIT_BYTES, captures_per_file=CAPTURES_PER_FILE):
    """Write the transactions of all pages as compressed archives below `folder`."""
    records = capture_records(pages, revisit_bytes)
    writer = records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * captures_per_file).text(folder)


def _inflated(content):
    """Chunks of a plain file, or of a file of one or many gzip members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        inflater = zlib.decompressobj(31)
        while at < len(view) and not inflater.eof:
            piece = view[at : at + (1 << 20)]
            at += len(piece)
            yield inflater.decompress(piece)
        at -= len(inflater.unused_data)


def parse_archive(chunks):
    """Yield (position, headers, block) of every record; headers map lower-case names to lists of values.

    A file that ends inside a record raises: an archive is never read in part.
    """
    buffer, position, chunks = bytearray(), 0, iter(chunks)

    def fill(size):
        while len(buffer) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    def drop(size):
        nonlocal position
        del buffer[:size]
        position += size

    while True:
        while fill(2) and buffer[:2] == b"\r\n":
            drop(2)
        if not buffer:
            return
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError(f"archive ends inside the header at {position}")
        lines = re.sub(r"\r\n[ \t]+", " ", buffer[:end].decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {position}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = int(headers["content-length"][0])
        if not fill(end + 4 + length):
            raise ValueError(f"archive ends inside the block at {position}")
        yield position, headers, bytes(buffer[end + 4 : end + 4 + length])
        drop(end + 4 + length)


def _row(file, position, headers, block):
    def first(name):
        return headers.get(name, [None])[0]

    kind, media = first("warc-type"), first("content-type") or ""
    head, payload, size, fields = None, None, None, {}
    if media.startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8", "replace")
        if kind == "response":
            payload, size = body, len(body)
        elif kind == "revisit" and (found := re.search(r"(?im)^content-length:\s*([0-9]+)", head)):
            size = int(found[1])  # the length of the payload that the response holds
    elif media.startswith("application/warc-fields"):
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if line)
        fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
    elif kind in ("response", "resource"):
        payload, size = block, len(block)
    digest = first("warc-payload-digest")
    return (
        file, position, kind, first("warc-record-id"), headers.get("warc-concurrent-to", []), first("warc-refers-to"),
        first("warc-target-uri"), digest, len(block), head, payload, size, fields,
    )


def _parsed(frames):
    names = [part.split()[0] for part in re.split(r", (?=\w+ )", RECORD)]
    for frame in frames:
        for file, content in zip(frame["path"], frame["content"]):
            rows, size = [], 0
            for record in parse_archive(_inflated(content)):
                rows.append(_row(file, *record))
                size += len(record[2])
                if size > 8 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_archives(spark, folder):
    """Records of all archives below `folder`: identifiers, types, http head, payload and warc fields."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(_parsed, RECORD)


def assemble(records):
    """One nested row per capture: the response or revisit record, its request and its metadata.

    A request or metadata record belongs to the capture it names in WARC-Concurrent-To, or to the capture that
    names it. Where several of one type claim a capture, the first by file and position counts, whatever the
    order of reading. A capture without satellites has null structs, satellites without a capture are left out,
    captures with one identifier all come out. Rows of other types are ignored.
    """
    record = F.struct("file", "position", "record_id", "target_uri", "http_head", "fields").alias("record")
    captures = records.where(F.col("type").isin("response", "revisit", "resource"))
    others = records.where(F.col("type").isin("request", "metadata")).select("type", "record_id", "concurrent_to", record)
    naming = others.select(F.explode("concurrent_to").alias("capture_id"), "type", "record")
    named = captures.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other_id"))
    named = named.join(others, F.col("other_id") == F.col("record_id")).select("capture_id", "type", "record")

    def first(kind):
        own = F.col("type") == kind
        place = F.struct("record.file", "record.position")
        return F.min_by(F.when(own, F.col("record")), F.when(own, place)).alias(kind)

    satellites = naming.union(named).groupBy("capture_id").agg(first("request"), first("metadata"))
    return captures.join(satellites, F.col("record_id") == F.col("capture_id"), "left").drop("capture_id")


def archive_round_trip(pages, folder=None, revisit_bytes=REVISIT_BYTES):
    """Write all pages as archives, read them back and return one row per page.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to (page_id of the response of a
    revisit) and payload_verified (the digest of the payload that was read). Null html is an empty payload; null
    page_id and url come back as null; repeated rows come back repeated; an empty table gives no rows.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    folder = folder or scratch_path(spark)
    write_archives(pages, folder, revisit_bytes)
    verified = F.when(F.col("type") == "response", F.sha1("payload"))
    # Payloads are hashed where they are parsed: none is shuffled, and the three branches read stored narrow records.
    records = cut_lineage(read_archives(spark, folder).withColumn("payload_verified", verified).drop("payload"))
    captures = assemble(records).select(
        "record_id",
        F.col("type").alias("record_type"),
        F.col("refers_to").alias("refers_id"),
        F.element_at("metadata.fields", "page-id").cast(kind).alias("page_id"),
        F.get_json_object(F.element_at("metadata.fields", "url-json"), "$.url").alias("url"),
        "payload_bytes",
        F.regexp_extract("payload_digest", "([0-9a-f]{40})", 1).alias("payload_digest"),
        "payload_verified",
    )
    captures = cut_lineage(captures)
    # A capture id is a hash of page and payload, so equal ids belong to one page.
    holders = captures.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.first("page_id").alias("refers_to"))
    wanted = captures.join(holders, "refers_id", "left")
    return wanted.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_verified")
