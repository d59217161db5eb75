"""WARC records in a content-addressed archive of two tables: payloads and record headers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import new_folder
from .common import pick, small_batches, stored

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# High halves of record ids: of pages with an id, whose low half it is, and of others.
_NUMBERED, _UNNUMBERED = 0x73706172_6B774000, 0x73706172_6B774001


def record_id(page: int | None, digest: bytes, url: str | None) -> str:
    """A UUID that holds the page id, or for pages without one a hash of url and payload."""
    if page is None:
        high, low = _UNNUMBERED, int.from_bytes(hashlib.sha256(digest + (url or "").encode()).digest()[:8])
    else:
        high, low = _NUMBERED, page & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (2**64 - 1)
    return None if value >> 64 != _NUMBERED else low - 2**64 if low >= 2**63 else low


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(page: int | None, url: str | None, sha1: str, digest: bytes, n_bytes: int, response: bool, refers_to: int | None, date: str) -> bytes:
    """All bytes of a record before its payload: WARC header and HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", record_id(page, digest, url)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if not response:
        fields.append(("WARC-Profile", _PROFILE))
        if refers_to is not None:
            fields.append(("WARC-Refers-To", record_id(refers_to, digest, None)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (n_bytes if response else 0)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + http


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record at ``at``, and where the next one begins; ValueError if malformed."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(b"WARC/", at):
        raise ValueError(f"no WARC record at byte {at}")
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end with two empty lines")
    return fields, data[start:stop], stop + 4


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and its bytes where the record has them."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return length, body if fields["warc-type"] == "response" else None


def _payload(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [_payload(t) for t in batch.column(2).to_pylist()]
        made = [
            pa.array([sha1_base32(p) for p in payloads]), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
            pa.array([len(p) for p in payloads], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "url", "sha1", "digest", "n_bytes"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed payload by digest, for the first of equal payloads that the task meets in its last few thousand."""
    press, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        digests, data = [], []
        for text in batch.column(0).to_pylist():
            payload = _payload(text)
            if (digest := hashlib.sha256(payload).digest()) not in seen:
                if len(seen) >= 50_000:
                    seen.clear()
                seen.add(digest)
                digests.append(digest)
                data.append(press.compress(payload))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the tables ``payloads`` and ``headers`` under ``path``.

    ``payloads`` holds each distinct payload once, compressed, under its SHA-256.
    ``headers`` holds for each page all bytes of its record before the payload, and the
    digest of the payload if the record has one. Of pages with equal payloads of at least
    ``least_bytes`` bytes, the smallest id is a response and the others revisit it; smaller
    payloads are all responses. A null html is an empty payload. A page with a null id
    revisits a page that has one, or else is a response; rows that repeat the smallest
    id are all responses; a null url is left out of the header.
    """
    small_batches(pages.sparkSession)
    rows = pick(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    digests = stored(rows.mapInArrow(_digests, "id long, url string, sha1 string, digest binary, n_bytes long"), "digests")
    first = stored(digests.groupBy("digest").agg(F.min("id").alias("first")), "first")  # so that Spark can split a frequent digest in the join
    response = (F.col("n_bytes") < least_bytes) | F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    typed = digests.join(first, "digest").withColumn("response", response)

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pydict()
            made = [
                header(i, u, s, d, n, p, f, date)
                for i, u, s, d, n, p, f in zip(r["id"], r["url"], r["sha1"], r["digest"], r["n_bytes"], r["response"], r["first"], strict=True)
            ]
            kept = [d if p else None for d, p in zip(r["digest"], r["response"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(kept, pa.binary())], ["header", "digest"])

    typed.mapInArrow(headers, "header binary, digest binary").write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads = rows.select("html").mapInArrow(_contents, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    payloads.write.option("compression", "uncompressed").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive as exact bytes, one row each: (record).

    Payloads are checked against the digest they are stored under; a payload that is
    missing or differs is an error, never a shorter result. Equal records of repeated rows are all there;
    an archive of no pages gives no rows.
    """
    headers = spark.read.schema("header binary, digest binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, data binary").parquet(f"{path}/payloads")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for head, digest, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    payload = b""
                    if digest is not None:
                        if data is None:
                            raise ValueError(f"the archive has no payload {digest.hex()}")
                        payload = press.decompress(data)
                        if hashlib.sha256(payload).digest() != digest:
                            raise ValueError(f"the payload stored as {digest.hex()} has another digest")
                    out.append(head + payload + b"\r\n\r\n")
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    whole = headers.where("digest is not null").join(payloads, "digest", "left").select("header", "digest", "data")
    plain = headers.where("digest is null").select("header", "digest", F.lit(None).cast("binary").alias("data"))
    return whole.unionByName(plain).mapInArrow(build, "record binary")


_PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _parsed(whole: bytes, with_payload: bool) -> Iterator[tuple]:
    at = 0
    while at < len(whole):
        fields, block, at = parse(whole, at)
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        length, payload = payload_of(fields, block)
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if payload is not None and (len(payload) != length or sha1_base32(payload) != digest):
            raise ValueError(f"record {fields['warc-record-id']} does not hold the payload that its header names")
        yield page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), payload if with_payload else None


def parse_records(records: DataFrame, column: str = "record", with_payload: bool = True) -> DataFrame:
    """Fields and payload of each response or revisit in a binary column, which may hold many records, gzipped or not.

    Null or empty values hold no record; other columns are ignored; an empty table gives an empty result.
    Records without a page id in their record id have a null page_id, those without a URI a null url. What is no
    WARC record, or doesn't hold the payload that its header names, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = [r for x in batch.column(0).to_pylist() if x for r in _parsed(gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x, with_payload)]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256], strict=True), kinds, strict=True)], names)

    return pick(records, column).mapInArrow(run, _PARSED)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc or .warc.gz files, as ``parse_records`` gives them; empty files hold none.

    A file is one task's, so files should be of a usual size of about 1 GB or less.
    """
    return parse_records(spark.read.format("binaryFile").load(path), "content")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write an archive in the shared folder and read its records back.

    Returns one row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archive(pages, path, id_col, url_col, html_col, least_bytes)
    return parse_records(read_archive(spark, path), with_payload=False).drop("payload").withColumnRenamed("page_id", id_col)
