"""WARC (10): write archives in which repeated payloads are revisit records, and read them back.

Only headers (payload digest, length, page) meet in a shuffle. Where payloads repeat, the page with the
largest id keeps the response; the others get a revisit record that refers to it. Each record is a gzip
member of its own in a ``.warc.gz`` file, so tools can seek to it; a file is closed at ``FILE_BYTES``. Every
task streams its records to files with names of its own in the shared folder and returns their places; that
index, once it is stored, says which files count, and those of tasks that were lost or run twice are deleted.
Readers stream member by member, so a task holds one record at a time, and join revisits to the responses
they name.

Defined cases: a null html is an empty payload; a null page_id counts as smaller than any other, and equal
page_ids with one payload are all responses; a null url is written as an empty target; line ends are cut
out of urls; an empty table gives an empty folder; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import filesystem, materialize, new_path

#: Compressed bytes at which a file is closed; a record may go beyond it.
FILE_BYTES = 64 << 20
_READ, _SEND = 1 << 20, 4096  # bytes read at once; records a batch holds
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_END = "\r\n"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hex digits, four letters each."""
    sha = F.sha1(payload)

    def letters(k: Column) -> Column:
        v = F.conv(F.substring(sha, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat(*(letters(F.lit(k)) for k in range(8)))


def resolved(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", payload_digest(F.col("payload").cast("binary")))
    heads = rows.select("page_id", "n_bytes", "digest").where(F.col("n_bytes") >= least_bytes)
    # only digests that occur twice: when these are few, their true size lets the planner spare the payloads a shuffle
    again = heads.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select(F.col("digest").alias("__digest"), F.col("n_bytes").alias("__bytes"), "first"), "repeated")
    joined = rows.join(again, (F.col("digest") == F.col("__digest")) & (F.col("n_bytes") == F.col("__bytes")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "n_bytes", "digest", refers.alias("refers_to"))


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page-"), F.coalesce(page.cast("string"), F.lit("null"))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and the WARC record of each row, without the two line ends that close it."""
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=UTF-8{_END}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(_END + _END))
    first = F.col("refers_to").isNull()
    block = F.when(first, F.concat(http, F.col("payload"))).otherwise(F.lit(""))
    refers = F.when(~first, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"{_END}WARC-Profile: {_PROFILE}{_END}Refers-To-Page: "), F.col("refers_to").cast("string"), F.lit(_END)))
    head = F.concat(
        F.lit(f"WARC/1.0{_END}WARC-Type: "), F.when(first, "response").otherwise("revisit"), F.lit(f"{_END}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{_END}WARC-Date: {date}{_END}WARC-Target-URI: "), target, F.lit(f"{_END}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{_END}Page: "), own, F.lit(_END),
        F.coalesce(refers, F.lit("")), F.lit(f"Content-Type: application/http; msgtype=response{_END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END + _END),
    )
    return rows.select("page_id", F.concat(head, block).alias("value"))


def _write_batches(path: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From records (page_id, value) to their places (page_id, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"
        out, offset, files = None, 0, 0
        for batch in batches:
            at, names, sizes = [], [], []
            for value in batch.column(1):
                if out is None:
                    file = f"{name}-{files:04d}.warc.gz"
                    out, offset, files = store.open_output_stream(f"{root}/{file}", compression=None), 0, files + 1
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(value.as_buffer()) + packer.compress(_END.encode() * 2) + packer.flush()
                out.write(member)
                at.append(offset)
                names.append(file)
                sizes.append(len(member))
                offset += len(member)
                if offset >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(sizes, pa.int64())], names=["page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives in ``path``, a new folder; returns the index of their records: page_id, file, offset, length."""
    store, root = filesystem(path)
    store.create_dir(root)
    places = records(resolved(pages, page_id, url, html)).mapInArrow(_write_batches(path, file_bytes), "page_id bigint, file string, offset bigint, length bigint")
    index = materialize(places, "archive-index")
    counted = {r["file"] for r in index.select("file").distinct().toLocalIterator()}  # one name for FILE_BYTES of archive
    for found in store.get_file_info(fs.FileSelector(root)):
        if found.base_name not in counted:
            store.delete_file(found.path)
    return index


def members(source: BinaryIO) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    data = source.read(_READ)
    while data:
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(packer.decompress(data))
            data = packer.unused_data or source.read(_READ) if packer.eof else source.read(_READ)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], memoryview]:
    """Headers and block of a record."""
    end = record.index(b"\r\n\r\n")
    first, *lines = record[:end].decode().split(_END)
    if first != "WARC/1.0":
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return head, memoryview(record)[end + 4 : end + 4 + int(head["Content-Length"])]


_RECORD = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _RECORD)], names=[n for n, _ in _RECORD])

    rows = []
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inside = filesystem(path)
            with store.open_input_stream(inside, compression=None) as source:
                for record in members(source):
                    head, block = parse(record)
                    page, url = int(head["Page"]) if head["Page"] else None, head["WARC-Target-URI"]
                    if head["WARC-Type"] == "response":
                        payload = block[bytes(block[:512]).index(b"\r\n\r\n") + 4 :]
                        rows.append((page, url, "response", len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None))
                    else:
                        rows.append((page, url, "revisit", None, head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Refers-To-Page"])))
                    if len(rows) >= _SEND:
                        yield batch_of(rows)
                        rows = []
    if rows:
        yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest and refers_to of each record; a revisit has
    length and digest of the response it was joined to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path")  # tasks open the files
    rows = materialize(files.mapInArrow(_read_batches, "page_id bigint, url string, record_type string, size bigint, digest string, refers_to bigint"), "records")
    first = rows.where("record_type = 'response'")
    again = rows.where("record_type = 'revisit'")
    origin = first.select(F.col("page_id").alias("__page"), F.col("size").alias("__size"), F.col("digest").alias("__digest")).dropDuplicates(["__page", "__digest"])
    joined = again.join(origin, (F.col("refers_to") == F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    tail = lambda size: ["page_id", "url", "record_type", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to"]
    return first.select(*tail(F.col("size"))).unionByName(joined.select(*tail(F.col("__size"))))


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, page_id, url, html)
    return read_archives(spark, path)


_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', ((('0x' || substr(sha, {5 * k + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
#: The same rows in DuckDB's SQL.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
