"""WARC: archives written by Spark's text writer, read back as whole files, and assembled to captures.

Each record is a gzip member of its own. The writer takes members as lines without their last byte, which is 0 (the
length is less than 2**24), and 0 is its line separator; so any store that Spark writes to takes archives and the commit
protocol covers lost tasks. Files are bounded by bytes. A capture has a request, a response (or revisit) and a metadata
record; request and metadata name the response in WARC-Concurrent-To, by which the reader joins them again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of record in a file, and of a gzip member (its last byte is 0 below 2**24), and how hard to compress.
FILE_BYTES, _MEMBER, _LEVEL = 32_000_000, (1 << 24) - 1, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column, digits: int = 40) -> Column:
    """Base32 of hex digits, five at a time: 20 bits are four letters."""
    letters = []
    for i in range(0, digits, 5):
        n = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_B32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(key: Column, kind: str) -> Column:
    h = F.md5(F.concat(key, F.lit(f"/{kind}")))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, file_bytes: int = FILE_BYTES
) -> None:
    """Write three records for each row of pages to archives of gzip members below path.

    Payload: payload_col in UTF-8, null as empty. Of equal payloads of at least revisit_from bytes the one with the
    smallest id (null ids last, then the earlier row) is a response and the others are revisits that refer to it;
    smaller ones are all responses. Null url: urn:none. Repeated rows and null ids give records of their own. No rows:
    no records. Other columns are ignored. A file ends after file_bytes of record, so that a reader holds few; a record
    of 16 MB or more is several members.
    """
    p = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:none")), r"[\r\n]", "%0A").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = p.select("sha", key.alias("k")).groupBy("sha").agg(F.min("k").alias("first"))
    p = p.join(first, "sha").withColumn("digest", base32(F.col("sha")))
    name = lambda i, r: F.concat_ws("-", F.coalesce(i.cast("string"), F.lit("null")), r.cast("string"))
    own, of = name(F.col("id"), F.col("row")), name(F.col("first.id"), F.col("first.row"))
    again = (F.col("n") >= revisit_from) & (F.col("first.row") != F.col("row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    base = lambda kind, type_: [
        ("WARC-Type", type_), ("WARC-Record-ID", _urn(own, kind)), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")),
    ]
    with_ = ("WARC-Concurrent-To", _urn(own, "response"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    request = _record([*base("request", F.lit("request")), with_, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.regexp_replace("url", r"\s", "%20"), F.lit(" HTTP/1.1\r\n\r\n")))
    response = _record([*base("response", F.lit("response")), digest, ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(http, F.col("payload")))
    revisit = _record([*base("response", F.lit("revisit")), digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn(of, "response")), ("Content-Type", F.lit("application/http;msgtype=response"))], http)
    metadata = _record([*base("metadata", F.lit("metadata")), with_, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")))
    rows = p.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("record")).select(F.col("record").cast("binary").alias("record"))

    def members(batches):
        done = 0
        for batch in batches:
            out, part = [], []
            for record in batch.column(0):
                data = record.as_py() + b"\r\n\r\n"
                for i in range(0, len(data), _MEMBER):
                    member = gzip.compress(data[i : i + _MEMBER], _LEVEL, mtime=0)
                    out.append(member[:-1])
                    part.append(done // file_bytes)
                done += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(part, pa.int64())], names=["value", "part"])

    packed = in_arrow(rows, members, "value binary, part long").select(F.col("value").cast("string").alias("value"), "part")
    packed.write.partitionBy("part").option("lineSep", "\0").text(path)


def _unpacked(data: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members one after another; read by pieces, as what follows a member is copied where it ends."""
    view, at = memoryview(data), 0
    while at < len(data):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(data):
            given = view[at : at + piece]
            yield d.decompress(given)
            at += len(given) - len(d.unused_data)


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields by lower-case name, block) of each record of an archive, gzip members or not.

    Blocks are cut by Content-Length alone, so a payload may hold anything. Empty data: none. Raises ValueError where
    a record does not start with WARC/ or is cut short.
    """
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_unpacked(data))
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or head < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        start, n = head + 4, int(fields["content-length"])
        if start + n > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, fields, data[start : start + n]
        at = start + n
        while data[at : at + 2] == b"\r\n":
            at += 2


_SCHEMA = "file string, offset long, type string, record_id string, concurrent_to string, refers_to string, url string, digest string, own_digest string, payload_bytes long, note string, payload binary"


def _parse(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, f, block in records_of(content.as_py()):
                    kind, payload = f.get("warc-type"), None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                    rows.append((
                        path, at, kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"),
                        (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None,
                        len(payload) if payload is not None else None,
                        block.decode("utf-8", "replace") if kind == "metadata" else None,
                        payload if with_payload else None,
                    ))
                    if len(rows) >= 1000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return run


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _SCHEMA.split(", "))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below path; own_digest and payload_bytes are computed from the payload read.

    Parsed once and written, as captures are assembled from several readings. A path without archives has no records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return cut(in_arrow(files, _parse(with_payload), _SCHEMA), "warc-records")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture struct of the response or revisit, request struct, metadata struct.

    Request and metadata records join by concurrent-to; a revisit joins the response that it refers to, whose payload
    length and digest it takes. Captures without a request or metadata record hold nulls there.
    """
    main = records.filter(F.col("type").isin("response", "revisit"))
    side = records.filter(F.col("type").isin("request", "metadata"))
    # Both side records of a capture meet in one row before the join; at most two per capture.
    part = lambda kind: F.max(F.when(F.col("type") == kind, F.struct("record_id", "file", "offset", "note")))
    sides = side.groupBy(F.col("concurrent_to").alias("record_id")).agg(part("request").alias("request"), part("metadata").alias("metadata"))
    source = main.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("source_bytes"), F.col("own_digest").alias("source_digest"))
    found = main.join(sides, "record_id", "left").withColumnRenamed("refers_to", "ref")
    return found.join(source, F.col("ref") == F.col("refers_to"), "left").select(
        F.struct("record_id", "type", "url", "digest", "file", "offset", "payload").alias("capture"),
        "request",
        "metadata",
        F.col("ref").alias("refers_to"),
        F.coalesce("payload_bytes", "source_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "source_digest").alias("payload_digest"),
        F.nullif(F.regexp_extract("metadata.note", r"^page-id: ([^\r]*)", 1), F.lit("")).alias("page_id"),
    )
