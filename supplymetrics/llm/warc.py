"""WARC archives: one gzip member per record, written by Spark and read back sequentially.

Writing: pages whose payload (at least ``MIN_REVISIT_BYTES`` long) occurs more than once become one response, that of the
largest page id, and revisits that refer to it. Every record is framed by its Content-Length, carries SHA-1 digests
of block and payload, and is compressed as a gzip member of its own. The members are written by Spark's text writer (so
by its committers, to any store that Spark reaches), one zero byte after each: gzip readers skip zero padding between
members.

Reading: a task inflates each file member by member with incremental zlib, in steps of ``STEP`` bytes, cuts the
record by its Content-Length, and verifies both digests; a record that is cut short, has another length or another digest
raises ``WarcError``.

Scale: payloads are shuffled once, by page id; only ids and digests meet by digest, where a payload
held by a third of all pages is one partial maximum per task and a join that AQE splits. A file is read by one task, so
its size is bounded: files hold at most ``RECORDS_PER_FILE`` records, and a payload over ``LARGE_BYTES`` has a file of its own.
A lost executor costs its tasks: members depend on the page alone and files are committed.

Defined results: a null html is an empty payload; a null url is archived as the record's own URN; pages repeated with
the same id and html are repeated records, all responses if theirs is the largest id; a null id is the smallest of all;
an empty table gives an empty archive and result; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut, ship
from supplymetrics.session import checkpoint_dir

ship(__name__)

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2000
LARGE_BYTES = 1 << 19
STEP = 1 << 16
DATE = "2026-01-01T00:00:00Z"  # one date for all records, so that reruns write the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


class WarcError(ValueError):
    """An archive that breaks its framing or its digests."""


def record_id(page_id: str | int | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(name: str) -> str | None:
    value = name.removeprefix("<urn:page").removesuffix(">")
    return unquote(value[1:]) if value else None


def head(lines: Iterable[str]) -> bytes:
    return "\r\n".join(lines).encode() + END


def member(page_id: str | int | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    digest = hashlib.sha1(payload).hexdigest()
    http = head(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"])
    block = http if revisit else http + payload
    uri = record_id(page_id)[1:-1] if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~")
    kind = ["WARC-Type: revisit", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else ["WARC-Type: response"]
    warc = head(["WARC/1.1", *kind, f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
                 f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
                 "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    return gzip.compress(warc + block + END, 6, mtime=0)


def headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = data.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def members(data: bytes | memoryview) -> Iterator[bytearray]:
    """The inflated members of a file, one after another, skipping zero padding between them."""
    data, at = memoryview(data), 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        inflate, out = zlib.decompressobj(wbits=31), bytearray()
        while not inflate.eof:
            piece = data[at:at + STEP]
            if not len(piece):
                raise WarcError("the last member is cut short")
            try:
                out += inflate.decompress(piece)
            except zlib.error as e:
                raise WarcError(f"a member cannot be inflated: {e}") from e
            at += len(piece) - len(inflate.unused_data)
        yield out


def read_record(data: bytes | bytearray) -> tuple:
    """The fields of ``RECORD`` of one inflated record, after all checks."""
    end = data.find(END)
    if end < 0:
        raise WarcError("a record without the end of its headers")
    version, h = headers(bytes(data[:end]))
    if not version.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    start, length = end + len(END), int(h["content-length"])
    block = bytes(data[start:start + length])
    if len(block) != length or bytes(data[start + length:]) != END:
        raise WarcError(f"{h['warc-record-id']}: the block is not {length} bytes long")
    if f"sha1:{hashlib.sha1(block).hexdigest()}" != h["warc-block-digest"]:
        raise WarcError(f"{h['warc-record-id']}: the block's digest differs")
    cut = block.find(END)
    size = int(headers(block[:cut])[1]["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response":
        payload = block[cut + len(END):]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError(f"{h['warc-record-id']}: the payload's length or digest differs")
        refers = None
    else:
        refers = page_of(h["warc-refers-to"])
    return page_of(h["warc-record-id"]), h["warc-target-uri"], size, digest, h["warc-type"], refers


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(again_id, again_digest, refers_to): the pages whose record refers to another one."""
    digest = F.sha1(F.col("html").cast("binary"))
    long = pages.filter(F.octet_length("html") >= min_bytes).select("page_id", digest.alias("digest"))
    kept = (long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("digest", "refers_to"))
    return (long.join(kept, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
            .select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to").distinct())


def with_revisits(pages: DataFrame, again: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): what each page's record is."""
    digest = F.sha1(F.col("html").cast("binary"))
    match = F.col("page_id").eqNullSafe(F.col("again_id")) & (digest == F.col("again_digest"))
    return pages.select("page_id", "url", "html").join(again, match, "left").select(
        "page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE,
                  large_bytes: int = LARGE_BYTES) -> None:
    """Write the pages as gzip members under ``path``; payloads over ``large_bytes`` in files of one record."""
    @F.pandas_udf("binary")
    def build(ids: pd.Series, urls: pd.Series, pages_html: pd.Series, refers: pd.Series, revisit: pd.Series) -> pd.Series:
        return pd.Series([member(i, u, (t or "").encode("utf-8", "replace"), r, bool(v))
                          for i, u, t, r, v in zip(ids, urls, pages_html, refers, revisit)], dtype=object)

    # no more tasks than full files, so that a small table over many partitions does not become many crumbs
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // records_per_file))
    again = cut(revisits(pages, min_bytes).coalesce(tasks))
    large = F.coalesce(F.octet_length("html") > large_bytes, F.lit(False))
    for rows, most, mode in ((pages.filter(~large), records_per_file, "errorifexists"), (pages.filter(large), 1, "append")):
        # ids of any type travel as strings
        records = with_revisits(rows, again).select(
            build(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "revisit").cast("string").alias("value"))
        records.coalesce(tasks).write.mode(mode).option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    fields = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.string())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [read_record(m) for m in members(content.as_buffer())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*found), fields)],
                                                     names=[n for n, _ in fields])

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORD)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Archive the pages in the shared folder and read the archive back."""
    path = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **settings)
    return read_archive(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
