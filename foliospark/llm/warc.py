"""WARC archives: writing records, and reading them back with segment reassembly.

Writing: one response record for each page, or a revisit of the record that holds the
same payload. The HTTP block is chunked, and cut into continuation records where it is
longer than SEGMENT. Spark's text sink writes the files, gzip-compressed: the separator
of its lines is the end of a WARC record. A file holds at most PER_FILE records of
bounded size, so reading one needs bounded memory.

Reading: files are parsed by Content-Length. Whole records are decoded where they are
read; records with a segment number are grouped by their origin's identifier, ordered
by segment number and joined, and the length that the last segment states is verified.
Chunked transfer framing is decoded and the payload digest verified.

Defined cases: null html is an empty payload; a null page_id is written without that
header and reads back as null, and never stands for other pages; rows that repeat the
id and payload of a response are responses; empty tables give empty archives and
results. Records that do not verify come back with ``error`` set. A file that cannot be
read to its end gives the records before that place, and one row that has only ``error``,
with the file's path and what stopped it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.kernels import slices
from foliospark.llm.shared import shared_dir, written

SEGMENT = 16 << 10
PER_FILE = 2000
CHUNK = 4 << 10
REVISIT_FROM = 1000
VERSION = "WARC/1.1"
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer framing of a payload."""
    out = [b"%x\r\n%s\r\n" % (len(x := payload[i : i + size]), x) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";", 1)[0].strip(), 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than stated")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, key: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without the separator that ends each."""
    name = f"<urn:uuid:{uuid.UUID(hex=key)}>"
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", name), ("WARC-Target-URI", clean if url is not None else None), ("WARC-Date", "2024-01-01T00:00:00Z"), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        return [_record("revisit", [*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], _HTTP)]
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        return [_record("response", common, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", [*common, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = uuid.UUID(bytes=hashlib.md5(f"{key}{k}".encode()).digest())
        more = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record("continuation", [("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Date", "2024-01-01T00:00:00Z"), *more], part))
    return out


def _emit_records():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            out: list[bytes] = []
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "kind", "refers_to", "key")), strict=True):
                out += page_records(r[0], r[1], (r[2] or "").encode(), *r[3:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def described(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, record type and the response that a revisit refers to."""
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    first = written(body.groupBy("digest").agg(F.max("page_id").alias("first")), "responses")
    out = body.join(first, "digest")
    again = (F.octet_length(F.coalesce("html", F.lit(""))) >= REVISIT_FROM) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("first"))
    return out.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages (page_id, url, html) as WARC files under ``path``."""
    keyed = described(pages).withColumn("key", F.md5(F.concat_ws("/", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string"))))
    records = keyed.mapInArrow(_emit_records(), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record in a WARC file's bytes."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError("record shorter than stated")
        yield head, block
        at = stop + 4 + size
        if data[at : at + 4] != END:
            raise ValueError(f"no record end at byte {at}")
        at += 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def checked(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    """(payload, error) of a response's block."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, f"framing: {e}"
    if digest and hashlib.sha1(payload).hexdigest() != digest.removeprefix("sha1:").lower():
        return payload, "digest differs"
    return payload, None


_READ = (
    "origin string, page_id long, url string, record_type string, refers_to long, digest string, "
    "segment int, total long, block binary, payload binary, error string"
)
_READ_ARROW = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])


def _inflated(data: bytes) -> tuple[bytes, str | None]:
    """What the gzip members of a file hold, as far as they can be read, and what stopped it."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    whole, rest = [], data
    while rest:
        d = zlib.decompressobj(31)
        try:
            whole.append(d.decompress(rest))
        except zlib.error as e:
            return b"".join(whole), str(e)
        if not d.eof:
            return b"".join(whole), "the last gzip member is cut short"
        rest = d.unused_data
    return b"".join(whole), None


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """The records of a file; where it cannot be read on, what stopped it as the last item."""
    data, stopped = _inflated(data)
    try:
        yield from parse(data)
    except (ValueError, KeyError) as e:
        stopped = stopped or (f"a header lacks {e}" if isinstance(e, KeyError) else str(e))
    if stopped:
        yield stopped


def _number(text: str | None) -> int | None:
    """A header's number; null where it is none."""
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows, held = [], 0
            for record in _records(content.as_py()):
                if isinstance(record, str):
                    rows.append([None] * (len(_READ_ARROW) - 1) + [f"{path}: {record}"])
                    continue
                head, block = record
                kind = head.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                number = head.get("warc-segment-number")
                page, refers = head.get("x-page-id"), head.get("warc-refers-to", "")
                row = [
                    head.get("warc-segment-origin-id") or head.get("warc-record-id"), _number(page), head.get("warc-target-uri"), kind, _number(refers.removeprefix("<urn:page:").removesuffix(">")) if refers.startswith("<urn:page:") else None,
                    (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, _number(number), _number(head.get("warc-segment-total-length")),
                ]
                if number:
                    row += [block, None, None]
                elif kind == "revisit":
                    row += [None, None, None]
                else:
                    row += [None, *checked(block, head.get("warc-payload-digest"))]
                rows.append(row)
                held += len(block)
                if held > 4 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            yield _rows(rows)


def _rows(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_READ_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _READ_ARROW, strict=True)], schema=_READ_ARROW)


def reassembled(segments: list[tuple[int, int | None, bytes]], digest: str | None) -> tuple[bytes | None, str | None]:
    """Join (number, total, block) segments in order of their numbers and decode them."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        return None, "segments are missing or repeat"
    block, total = b"".join(s[2] for s in segments), segments[-1][1]
    if total is None:
        return None, "the last segment is missing"
    if total != len(block):
        return None, "total length differs"
    return checked(block, digest)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            payload, error = reassembled([(s["segment"], s["total"], s["block"]) for s in r["parts"]], r["digest"])
            rows.append([r["origin"], r["page_id"], r["url"], r["record_type"], None, r["digest"], None, None, None, payload, error])
        yield _rows(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, digest, payload, error of the records under ``path``."""
    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse_files, _READ)
    whole = read.where("segment is null")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = read.where("segment is not null").groupBy("origin").agg(
        *[first(c) for c in ("page_id", "url", "record_type", "digest")], F.collect_list(F.struct("segment", "total", "block")).alias("parts")
    )
    cols = ["page_id", "url", "record_type", "refers_to", "digest", "payload", "error"]
    return whole.select(*cols).unionByName(parts.mapInArrow(_reassemble, _READ).select(*cols))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to and error of each; a revisit has its size from the record it refers to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    got = read_archives(spark, path).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"), "error")
    got = written(got, "read-back")
    sizes = written(got.where("record_type = 'response' and error is null").groupBy("sha").agg(F.max("size").alias("known")), "sizes")
    out = got.join(sizes, got["digest"] == sizes["sha"], "left").drop(sizes["sha"])
    return out.select(
        "page_id", F.coalesce("size", "known").alias("payload_bytes"), F.coalesce(got["sha"], got["digest"]).alias("payload_digest"), "record_type", "refers_to",
        F.when((F.col("record_type") == "revisit") & F.col("known").isNull(), F.lit("the record referred to is missing")).otherwise(F.col("error")).alias("error"),
    )
