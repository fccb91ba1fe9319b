"""WARC archives: writing, reading, and revisit resolution.

An archive is a folder of files of some ``FILE_BYTES``, each a sequence of WARC 1.1 records, a gzip member a record. Files
are written and read by Spark's own sink and source, so any store that Spark reaches will do. Records of one payload are
found from headers alone: these are shuffled by payload digest, combined before the shuffle, one of each digest stays
the response and all others become revisits of it, written anew with fresh headers and without a payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, saved, shared_dir, small, table

#: Compressed bytes of one file, unless a single record has more; a task keeps so many.
FILE_BYTES = 32_000_000
LEVEL = 3
#: Bytes of inflated data that are looked at while a record's headers are sought, and read at once.
STEP = 1 << 16
#: Fixed values of the format: the version line, the profile of a revisit of the same payload, what follows a record.
VERSION, PROFILE, END = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"
#: The text sink ends a file with its line separator; here that is an empty gzip member.
NOTHING = gzip.compress(b"", mtime=0)

RECORD = "page_id bigint, url string, date string, payload binary"
READ = "file string, at bigint, page_id bigint, url string, date string, record_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
READ_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def field(name: str, value: str | int | None) -> bytes:
    """A header line, none for a null; what would end the line is written as %0D and %0A."""
    return b"" if value is None else f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, date: str, size: int, sha: str, payload: bytes | None, refers: tuple | None = None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of ``refers`` (record id, url, date)."""
    block = b"HTTP/1.1 200 OK\r\n" + field("Content-Type", "text/html; charset=utf-8") + field("Content-Length", size) + b"\r\n" + (payload or b"" if refers is None else b"")
    head = VERSION + b"\r\n" + field("WARC-Type", "response" if refers is None else "revisit") + field("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + field("WARC-Date", date) + field("WARC-Target-URI", url) + field("WARC-Page-ID", page_id)
    head += field("WARC-Payload-Digest", f"sha1:{sha}")
    if refers is not None:
        head += field("WARC-Profile", PROFILE) + field("WARC-Refers-To", refers[0]) + field("WARC-Refers-To-Target-URI", refers[1]) + field("WARC-Refers-To-Date", refers[2])
    head += field("Content-Type", "application/http; msgtype=response") + field("Content-Length", len(block))
    return gzip.compress(head + b"\r\n" + block + END, LEVEL, mtime=0)


def _files(members: Iterator[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Members put together to files, a row each."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.large_binary() if size >= 1 << 31 else pa.binary())], names=["file"])

    for m in members:
        if held and size + len(m) > most:
            yield out()
            held, size = [], 0
        held.append(m)
        size += len(m)
    if held:
        yield out()


def _write(files: DataFrame, folder: str) -> None:
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(folder)


def write(records: DataFrame, folder: str, most: int = FILE_BYTES) -> None:
    """Writes each row (page_id, url, date, payload) as a response record.

    A null payload is an empty one, a null page_id or url has no header, repeated rows are written repeatedly; an empty
    table gives a folder without records. Other columns are not read.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, date, payload = (c[k].as_py() for c in batch.columns)
                payload = payload or b""
                yield record(page_id, url, date, len(payload), digest(payload), payload)

    _write(only(records, page_id="bigint", url="string", date="string", payload="binary").mapInArrow(lambda batches: _files(members(batches), most), "file binary"), folder)


def _members(file: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of each gzip member that is not empty."""
    view, at = memoryview(file), 0
    while at < len(view):
        part, size, inflate = [], at, zlib.decompressobj(31)
        while not inflate.eof and size < len(view):
            part.append(inflate.decompress(view[size : size + STEP]))
            size += STEP
        if not inflate.eof:
            raise ValueError(f"a record at byte {at} is cut off")
        end = min(size, len(view)) - len(inflate.unused_data)
        data = b"".join(part)
        if data:
            yield at, data
        at = end


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record; lengths say where it ends, not what stands in it."""
    if not data.startswith(VERSION + b"\r\n"):
        raise ValueError("not a WARC record")
    end = data.index(END)
    head = _fields(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    if data[end + 4 + len(block) :] != END:
        raise ValueError("a record's length is wrong")
    cut = block.index(END)
    return head, _fields(block[:cut]), block[cut + 4 :]


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive (READ), each with its file and place there; without ``payloads`` these are null.

    Digest and size of a response are taken from the payload that was read, and must be those its headers tell; a revisit
    has those of the payload it stands for, from its headers. An archive without records gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows = batch.column("path")[k].as_py(), []
                for at, data in _members(batch.column("content")[k].as_py()):
                    head, http, payload = parsed(data)
                    sha, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response" and (digest(payload) != sha or len(payload) != int(http["content-length"])):
                        raise ValueError(f"payload of {head['warc-record-id']} is not what its headers tell")
                    page = head.get("warc-page-id")
                    rows.append((path, at, None if page is None else int(page), head.get("warc-target-uri"), head["warc-date"], head["warc-record-id"], kind, head.get("warc-refers-to"), int(http["content-length"]), sha, payload if payloads and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(READ_ARROW), READ_ARROW)], schema=READ_ARROW)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInArrow(run, READ)


def resolved(headers: DataFrame, at_least: int = 0) -> tuple[DataFrame, int]:
    """Revisits among (page_id, url, date, record_id, payload_bytes, payload_digest): a row (record_id, refers_to, refers_url, refers_date) each; and their number.

    Of the records of a payload of ``at_least`` bytes that with the largest page_id stays (nulls are smallest; equal ids
    by record id), all others revisit it. A payload that a third of all records have is combined before its shuffle, and
    the records that repeat it are looked up in a table of one row a repeated payload.
    """
    own = headers.where(F.col("payload_bytes") >= at_least)
    best = F.max(F.struct("page_id", "record_id", "url", "date")).alias("first")
    firsts, n = saved(own.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), best).where("n > 1").select("payload_digest", "payload_bytes", "first"), rows=True)
    met = own.join(small(firsts, n), ["payload_digest", "payload_bytes"]).where(F.col("record_id") != F.col("first.record_id"))
    return saved(met.select("record_id", F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("refers_url"), F.col("first.date").alias("refers_date")), rows=True)


def deduplicated(spark: SparkSession, folder: str, target: str, at_least: int = 0, most: int = FILE_BYTES) -> None:
    """Writes the archive in ``folder`` to ``target`` with every repeated payload as a revisit; all records get fresh headers.

    Revisits are written after the responses, as they name the fresh record ids of these. Payloads are never shuffled but
    where the revisits are too many to be broadcast.
    """
    headers = read(spark, folder, payloads=False).where("record_type = 'response'")
    headers = saved(headers.select("page_id", "url", "date", "record_id", "payload_bytes", "payload_digest"))
    revisits, n = resolved(headers, at_least)
    gone = small(revisits.select("record_id"), n)
    kept = read(spark, folder).where("record_type = 'response'").join(gone, "record_id", "left_anti")
    write(kept, f"{target}/responses", most)
    # The responses' fresh ids, for those that something refers to.
    fresh = read(spark, f"{target}/responses", payloads=False).select("page_id", "payload_digest", "payload_bytes", F.col("record_id").alias("new_id"), F.col("url").alias("refers_url"), F.col("date").alias("refers_date"))
    again = headers.join(gone, "record_id").select("page_id", "url", "date", "payload_bytes", "payload_digest")
    asked = again.groupBy("payload_digest", "payload_bytes").agg(F.lit(1).alias("asked"))
    known, m = saved(fresh.join(asked, ["payload_digest", "payload_bytes"]).drop("asked", "page_id"), rows=True)
    rows = again.join(small(known, m), ["payload_digest", "payload_bytes"]).select("page_id", "url", "date", "payload_bytes", "payload_digest", "new_id", "refers_url", "refers_date")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, date, size, sha, *refers in zip(*(c.to_pylist() for c in batch.columns)):
                yield record(page_id, url, date, size, sha, None, tuple(refers))

    _write(rows.mapInArrow(lambda batches: _files(members(batches), most), "file binary"), f"{target}/revisits")


def followed(records: DataFrame) -> DataFrame:
    """``records`` of an archive with ``original``, the page_id of the response that a revisit refers to, null for responses."""
    asked = records.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("id")).agg(F.lit(1).alias("asked"))
    known, n = saved(records.where("record_type = 'response'").join(asked, F.col("record_id") == F.col("id")).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original")), rows=True)
    return records.join(small(known, n), "refers_to", "left")


def pages_as_records(pages: DataFrame) -> DataFrame:
    """Rows to write from (page_id, url, html), at one date."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("html").cast("string").cast("binary").alias("payload"))


def archive(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Writes pages as an archive, deduplicates it, and gives the records of the second archive (READ and original)."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages_as_records(pages), f"{folder}/raw")
    deduplicated(spark, f"{folder}/raw", f"{folder}/deduplicated", at_least)
    return followed(saved(read(spark, f"{folder}/deduplicated", payloads=False)))


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("original").alias("refers_to"))


_SHIFTED = "(CAST('0x' || substr(h, k * 5 + 1, 5) AS BIGINT) >> s) % 32 + 1"
OP11_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, row_number() OVER w AS n, first_value(page_id) OVER w AS top FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST))
SELECT page_id, octet_length(encode(t)) AS payload_bytes, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_SHIFTED}, 1)), '')), '') AS payload_digest,
CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN top END AS refers_to FROM p"""
