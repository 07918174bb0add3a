"""WARC archives: writing with revisits and segments, reading with reassembly.

*Writing.* Every page becomes one record. The block of a response is an HTTP
message whose body, the page's html in UTF-8, is in chunked transfer framing.
A block over ``segment_bytes`` is written as segments: the response holds the
first, ``continuation`` records the others, the last of which has the total
length. Of pages with equal payloads of at least ``least`` bytes the one with
the largest page_id is the response; the others are ``revisit`` records that
refer to it and carry no payload. Records are packed into archives of about
``archive_bytes``; Spark's own text writer puts them into files, its line
separator being the two line ends that close a record and gzip its codec, so
the files are compressed WARC files on any file system that Spark writes.

*Reading.* Every archive is parsed by its content lengths, independently of
the others. Segments are grouped by the identifier of their origin, wherever
they lie, ordered by segment number, checked to be gapless and of the stated
total length and joined; a record that isn't segmented is whole where it is
read and goes through no shuffle. Blocks are taken out of the chunked framing
and the SHA-1 is compared with the record's digest. Revisits take their payload's
length and digest from the response they refer to.

A group has the segments of one record, so its size is that of one page. Hot
payloads meet only as short rows (digest, page_id): a partial aggregate finds
the response, a join that adaptive execution can split tells the revisits.

Defined cases: null html is an empty payload; a null url is an empty target; a
null page_id is a page like any other but never refers or is referred to;
repeated rows of one page_id with equal payloads are written each, all with
the same record type; broken archives (missing segments, wrong lengths or
digests) raise an error; an empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, work_area

END = b"\r\n\r\n"
DATE = b"2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        c = payload[i : i + size]
        parts += [b"%x\r\n" % len(c), c, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a chunk's extensions and the trailer are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(parts[-1]) != n or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += 2


def _line(text: str | None) -> bytes:
    """A header value: line ends would break the record, so they are escaped."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode() if text and ("\r" in text or "\n" in text) else (text or "").encode()


def _record(kind: bytes, ident: bytes, block: bytes, *fields: tuple[bytes, bytes]) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + ident + b">", b"WARC-Date: " + DATE]
    head += [k + b": " + v for k, v in fields]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block)]) + END + block


def page_records(page_id, url, payload: bytes, digest: str, refers_to, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the line ends that close them."""
    ident = b"urn:uuid:" + str(uuid.uuid4()).encode()
    fields = [(b"WARC-Target-URI", _line(url)), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if page_id is not None:
        fields.append((b"X-Page-Id", b"%d" % page_id))
    if refers_to is not None:
        fields += [(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"X-Refers-To-Page-Id", b"%d" % refers_to)]
        return [_record(b"revisit", ident, HTTP_HEAD, *fields)]
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record(b"response", ident, block, *fields)]
    out, count = [], -(-len(block) // segment_bytes)
    for k in range(count):
        part, number = block[k * segment_bytes : (k + 1) * segment_bytes], (b"WARC-Segment-Number", b"%d" % (k + 1))
        if k == 0:
            out.append(_record(b"response", ident, part, *fields, number))
            continue
        more = [(b"WARC-Segment-Origin-ID", b"<" + ident + b">"), number]
        if k == count - 1:
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_record(b"continuation", b"urn:uuid:" + str(uuid.uuid4()).encode(), part, *more))
    return out


def parse_records(data: bytes):
    """(headers, block) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(b":", 1) for x in lines[1:])}
        n = int(head[b"content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) != n or data[at : at + 4] != END:
            raise ValueError("broken record")
        at += 4
        yield head, block


def reassemble(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a record from its segments."""
    segments = sorted(segments)
    if [n for n, _ in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("missing or repeated segments")
    block = b"".join(x for _, x in segments)
    if (total is None) != (len(segments) == 1) or total is not None and total != len(block):
        raise ValueError("segments don't add up to the total length")
    return block


def write_archives(pages: DataFrame, folder: str, least: int = 1000, segment_bytes: int = 32 << 10, archive_bytes: int = 16 << 20) -> None:
    """Write the WARC files of pages (page_id, url, html) into folder."""
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("digest", F.sha1("payload"))
    slim = own.filter(F.octet_length("payload") >= least).select("page_id", "same")
    heads = slim.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "refers_to")
    revisits = slim.join(heads, "same").filter("page_id < refers_to").distinct()
    rows = own.join(revisits, ["page_id", "same"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                for rec in page_records(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], segment_bytes):
                    if held and size + len(rec) > archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["archive"])
                        held, size = [], 0
                    held.append(rec)
                    size += len(rec) + len(END)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["archive"])

    archives = rows.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of all archives in folder."""

    def headers(h: dict) -> dict:
        kind = h[b"warc-type"].decode()
        ident = h[b"warc-segment-origin-id" if kind == "continuation" else b"warc-record-id"]
        number, total, page, ref = (h.get(k) for k in (b"warc-segment-number", b"warc-segment-total-length", b"x-page-id", b"x-refers-to-page-id"))
        return {
            "origin": ident.decode(), "number": int(number) if number else None, "total": int(total) if total else None, "kind": kind,
            "page_id": int(page) if page else None, "refers_to": int(ref) if ref else None,
            "digest": h[b"warc-payload-digest"].decode().removeprefix("sha1:") if b"warc-payload-digest" in h else None,
        }

    def decoded(r: dict, block: bytes) -> dict:
        row = {"page_id": r["page_id"], "payload_bytes": None, "payload_digest": r["digest"], "record_type": r["kind"], "refers_to": r["refers_to"]}
        if r["kind"] == "response":
            payload = unchunked(block[block.index(END) + 4 :])
            if hashlib.sha1(payload).hexdigest() != r["digest"]:
                raise ValueError(f"{r['origin']}: payload differs from its digest")
            row["payload_bytes"] = len(payload)
            if with_payload:
                row["payload"] = payload
        return row

    def records(batches):
        """(headers, block) of the page records and segments, archive by archive."""
        for b in batches:
            for i in range(b.num_rows):
                data = gzip.decompress(b.column(0)[i].as_py())
                yield [(headers(h), block) for h, block in parse_records(data) if h[b"warc-type"] in (b"response", b"revisit", b"continuation")]

    def whole(batches):
        for found in records(batches):
            yield pa.RecordBatch.from_pylist([decoded(r, block) for r, block in found if r["number"] is None], schema)

    def segments(batches):
        for found in records(batches):
            yield pa.RecordBatch.from_pylist([r | {"block": block} for r, block in found if r["number"] is not None], parsed)

    def joined(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                if r["kind"] is None:
                    raise ValueError(f"{r['origin']}: continuation without its origin")
                out.append(decoded(r, reassemble([(x["number"], x["block"]) for x in r["segments"]], r["total"])))
            yield pa.RecordBatch.from_pylist(out, schema)

    parsed = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()),
                        ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    parts = files.mapInArrow(segments, "origin string, number int, total long, kind string, page_id long, refers_to long, digest string, block binary")
    first = F.col("kind") != "continuation"
    groups = parts.groupBy("origin").agg(
        F.collect_list(F.struct("number", "block")).alias("segments"),
        F.max("total").alias("total"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("kind", "page_id", "refers_to", "digest")],
    )
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else [])])
    fields = RECORD + (", payload binary" if with_payload else "")
    pages = files.mapInArrow(whole, fields).unionByName(groups.mapInArrow(joined, fields))
    pages = work_area(spark).write(pages, "records")
    served = pages.filter("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes"),
        *([F.col("payload").alias("of_payload")] if with_payload else []),
    ).dropDuplicates(["of_page", "of_digest"])
    revisit = (pages["record_type"] == "revisit") & (pages["refers_to"] == served["of_page"]) & (pages["payload_digest"] == served["of_digest"])
    back = pages.filter("record_type = 'revisit'").join(served, revisit)
    cols = ["page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    if with_payload:
        cols.append(F.coalesce("payload", "of_payload").alias("payload"))
    plain = pages.filter("record_type = 'response'")
    return plain.unionByName(back.select(*cols))


def op6_warc_segments(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = work_area(spark).path("archives")
    write_archives(pages, folder)
    return read_archives(spark, folder)


OP6_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT sha256(payload) AS same, max(page_id) AS head FROM p WHERE octet_length(payload) >= 1000 GROUP BY 1
)
SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN octet_length(payload) >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(payload) >= 1000 AND head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN g ON sha256(p.payload) = g.same"""
