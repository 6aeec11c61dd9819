"""WARC archives: a gzip member per record, written by Spark, read back by Content-Length, and assembled into one nested row per capture."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads under this many bytes are never revisits.
MIN_REVISIT_BYTES = 100
BASE_TYPES = ("response", "revisit", "resource")
#: Records of a file at most, so that a reader's task stays near that many records (three to a capture).
RECORDS_PER_FILE = 30_000
#: Bytes of a gzip member: under 2 ** 24, so that the last byte of its length is zero.
MEMBER_BYTES = 1 << 23
_EOL = "\r\n"
_RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, header_digest string, content_type string, block string, payload binary, payload_bytes long, payload_digest string"


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\r", "%0D"), "\n", "%0A")


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record without its closing two line ends, which the writer adds as line separator. Headers with a null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">"))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.lit(f"WARC/1.1{_EOL}"), F.concat_ws(_EOL, *lines), F.lit(_EOL * 2), block)


def _urn(*parts: Column | str) -> Column:
    """A record id that follows from its parts: a UUID of version 8."""
    digest = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "urn:uuid:$1-$2-8$3-8$4-$5")


def mark_revisits(captures: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """captures (page_id, url, payload string) with payload (null: empty), digest, payload_bytes, row (a number that repeated rows don't share) and
    refers_to, refers_row and refers_url of the response (null: is a response itself).

    Of equal payloads of min_bytes or more, the rows with the smallest page_id are responses; the others refer to it. Rows without an id are
    revisits if an equal payload has one, else responses. Other columns are left out; an empty table gives an empty one. The payload doesn't move for the grouping, and a digest that a third of all rows share is
    counted in part before the shuffle; adaptive execution splits it in the join."""
    own = captures.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    own = own.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = own.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    refers = [F.when(is_revisit, F.col(f"first.{name}")).alias(alias) for name, alias in (("page_id", "refers_to"), ("row", "refers_row"), ("url", "refers_url"))]
    return own.join(first, "digest", "left").select("page_id", "url", "payload", "row", "digest", "payload_bytes", *refers)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member (a long one as several) without its last byte, which is zero and is added by the writer as line separator."""
    for batch in batches:
        out = []
        for value in batch["value"]:
            record = value.as_py().encode("utf-8", "surrogatepass") + b"\r\n\r\n"
            packed = bytearray()
            for at in range(0, len(record), MEMBER_BYTES):
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed += member.compress(record[at : at + MEMBER_BYTES]) + member.flush()
            out.append(bytes(packed[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a response or revisit record per capture of mark_revisits(), with the request and metadata records that are concurrent to it.

    With gzip each record is a member of its own, so readers may seek to it (one over MEMBER_BYTES is several members, which gzip reads as one stream);
    compression="none" writes plain records. No file has more than records_per_file records. A revisit names the response's record, URI and date; its
    page id is in the metadata. Record ids follow from page id and row. A null url is an empty URI, a null payload an empty block; a payload is one
    record at any length under 2 GB. An empty table gives no records, and other columns of captures aren't read."""
    rows = captures.select("page_id", "url", "payload", "row", "digest", "payload_bytes", "refers_to", "refers_row", "refers_url")
    uri = _clean(F.col("url"))
    name = lambda kind: _urn(F.col("page_id"), F.col("row"), kind)
    main, when = name("main"), F.lit(date)
    beside = [("WARC-Target-URI", uri), ("WARC-Date", when), ("WARC-Concurrent-To", F.concat(F.lit("<"), main, F.lit(">")))]
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=UTF-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL * 2))
    body = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    headers = [
        ("WARC-Target-URI", uri), ("WARC-Date", when), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(is_revisit, F.concat(F.lit("<"), _urn(F.col("refers_to"), F.col("refers_row"), "main"), F.lit(">")))),
        ("WARC-Refers-To-Target-URI", F.when(is_revisit, _clean(F.col("refers_url")))), ("WARC-Refers-To-Date", F.when(is_revisit, when)),
    ]
    shown = F.regexp_extract(uri, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    records = F.array(
        _record("request", name("request"), beside, "application/http;msgtype=request", F.concat(F.lit("GET "), F.when(shown == "", F.lit("/")).otherwise(shown), F.lit(f" HTTP/1.1{_EOL * 2}"))),
        _record(F.when(is_revisit, "revisit").otherwise("response"), main, headers, "application/http;msgtype=response", body),
        _record("metadata", name("metadata"), beside, "application/warc-fields", F.concat_ws(_EOL, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-length: "), F.col("payload_bytes").cast("string")), F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string")), F.lit(""))),
    )
    values = rows.select(F.explode(records).alias("value"))
    packed = values.mapInArrow(_members, "value binary").select(F.col("value").cast("string")) if compression == "gzip" else values
    packed.write.option("lineSep", "\0" if compression == "gzip" else _EOL * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(content: bytes) -> Iterator[bytes]:
    """A file's bytes, a gzip member at a time; files that aren't gzip are one piece. A damaged member ends the file."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            part = view[at : at + 16_384]
            try:
                out.append(member.decompress(part))
            except zlib.error:
                yield b"".join(out)
                return
            at += len(part) - len(member.unused_data)
        yield b"".join(out)


def parse_records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of one file, by Content-Length, wherever its pieces are cut; header names in lower case. What a damaged tail has of a record is its block."""
    held = b""
    for piece in itertools.chain(pieces, [None]):
        held, at = held + (piece or b""), 0
        while (start := held.find(b"WARC/", at)) >= 0:
            end = held.find(b"\r\n\r\n", start)
            headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in held[start:end].decode("utf-8", "replace").split("\r\n")[1:])) if end >= 0 else {}
            size = int(headers.get("content-length") or 0)
            at = end + 4 + size if end >= 0 else len(held) + 1
            if at > len(held) and piece is not None:
                held, at = held[start:], 0
                break
            if end >= 0:
                headers["block"] = held[end + 4 : at]
                yield headers
        else:
            held = held[max(at, len(held) - 4) :]


def _parse(with_payload: bool):
    def row(r: dict) -> dict:
        kind, block = r.get("warc-type"), r["block"]
        bare = lambda name: (r.get(name) or "").strip("<>") or None
        payload = None
        if kind in BASE_TYPES:
            payload = block.partition(b"\r\n\r\n")[2] if r.get("content-type", "").startswith("application/http") else block
        return {
            "record_id": bare("warc-record-id"), "record_type": kind, "target_uri": r.get("warc-target-uri"), "concurrent_to": bare("warc-concurrent-to"),
            "refers_to": bare("warc-refers-to"), "header_digest": r.get("warc-payload-digest"), "content_type": r.get("content-type"),
            "block": block.decode("utf-8", "replace") if payload is None else None, "payload": payload if with_payload else None,
            "payload_bytes": None if payload is None else len(payload), "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in _RECORD.split(", ")])
        for batch in batches:
            for content in batch["content"]:
                held, weight = [], 0
                for r in parse_records(_pieces(content.as_py())):
                    held.append(row(r))
                    weight += 500 + len(r["block"])
                    if weight > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. payload_bytes and payload_digest are measured on the bytes read; with_payload=False leaves those bytes in the task.

    A task takes whole files and holds one of them packed, with one gzip member unpacked; binaryFile reads files of up to 2 GB."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse(with_payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, response, request, metadata): one nested row per response, revisit or resource record.

    Other records belong to the capture that their WARC-Concurrent-To names, that names them, or that a record they name belongs to. Where a capture
    has several requests or metadata records, the smallest id stands (records is read once for each side of the joins, so parsed archives are best written first); a record that leads to no capture is left out; a capture without them has nulls."""
    columns = F.struct(*[F.col(c) for c in records.columns])
    base = records.where(F.col("record_type").isin(*BASE_TYPES))
    rest = records.where(~F.col("record_type").isin(*BASE_TYPES)).select("record_id", "record_type", "concurrent_to", columns.alias("__r"))
    ids = base.select(F.col("record_id").alias("capture_id"), F.col("concurrent_to").alias("__names"))
    named = rest.join(ids, F.col("concurrent_to") == F.col("capture_id"), "left").select(*rest.columns, "capture_id")
    back = ids.where("__names IS NOT NULL").groupBy("__names").agg(F.min("capture_id").alias("__back"))
    known = named.join(back, F.col("record_id") == F.col("__names"), "left").select(*rest.columns, F.coalesce("capture_id", "__back").alias("capture_id"))
    links = known.where("capture_id IS NOT NULL").select(F.col("record_id").alias("__via"), F.col("capture_id").alias("__far")).dropDuplicates(["__via"])
    far = known.where("capture_id IS NULL").join(links, F.col("concurrent_to") == F.col("__via")).select(*rest.columns, F.col("__far").alias("capture_id"))
    sides = known.where("capture_id IS NOT NULL").unionByName(far).groupBy("capture_id").agg(*[F.min_by(F.when(F.col("record_type") == k, F.col("__r")), F.when(F.col("record_type") == k, F.col("record_id"))).alias(k) for k in ("request", "metadata")])
    return base.select(F.col("record_id").alias("capture_id"), columns.alias("response")).join(sides, "capture_id", "left")
