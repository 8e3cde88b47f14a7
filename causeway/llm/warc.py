"""WARC archives: write with an index first, then read selected records by coalesced byte ranges.

Writing: payload digests are grouped (a count and a largest id per digest, pre-aggregated on the map side), and those
that come more than once are written down; each row learns from them whether it is the response or a revisit (Spark
sends that table to the workers if it is small, else joins by shuffle), and each task writes its rows as gzip members
of one archive file in the shared folder. What it returns is the index: file, offset, length, URL, digest
and record id of each record. The index is written by Spark's own committer, so it names only files of attempts
that succeeded; a file left by a lost attempt is never read.

Reading: the index rows wanted are dealt by file and offset range, each task sorts its own by offset, joins
neighbours whose gap is at most ``most_gap`` bytes into one read of at most ``most_read`` bytes, and parses the
members. Payload digests and lengths of responses are recomputed and compared with the headers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import bounded, for_workers, new_folder, open_store, quoted, slices, written

INDEX = "file string, offset long, length long, url string, payload_digest string, record_id string, page_id long, record_type string, refers_to long"
RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)
#: The moment that all records of a run carry; a parameter of ``write``.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(value: str) -> str:
    """A header value: no line ends, so that no row can forge headers."""
    return re.sub(r"[\r\n]+", "%0A", value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = DATE) -> tuple[str, bytes]:
    """(record id, record). A revisit holds the HTTP headers only, with the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    record_id = f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return record_id, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record. Raises ValueError where lengths or digests do not fit."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block has another length")
    if "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block has another digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload has another length or digest")
    whole = lambda x: int(fields[x]) if x in fields else None
    return {
        "record_id": fields["WARC-Record-ID"], "page_id": whole("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_digest": digest, "payload_bytes": length, "refers_to": whole("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): refers_to is null for responses. Of equal payloads of at least
    ``least_bytes`` bytes the row with the largest id is the response; a group without any id has only responses."""
    payload = F.coalesce(quoted(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    slim = pages.select(quoted(id_col).cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"))
    again = slim.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(written(again, "warc-repeated"), "digest", "left")
    own = F.col("largest").isNull() | (F.octet_length("payload") < least_bytes) | F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("largest")).alias("refers_to"), (~own).alias("revisit"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, level: int = 4, file_bytes: int = 256 << 20) -> DataFrame:
    """Archives of ``pages`` in the shared folder; returns the index, one row per page.

    A null payload is empty. A null URL gives a record without target URI. Of repeated rows with the largest id each
    is a response; a group without any id has only responses. An empty table gives an empty index; other columns are
    not read, whatever their names.
    """
    spark = pages.sparkSession
    folder = for_workers(spark, new_folder(spark, "warc"))
    prepared = with_roles(pages, id_col, url_col, payload_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_store(folder)
        files.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in (part for whole in batches for part in slices(whole)):
                rows = []
                for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:  # a name of its own for each attempt
                        name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    kind, digest = "revisit" if revisit else "response", base32_sha1(payload)
                    record_id, record = make_record(page_id, url, payload, digest, kind, refers_to)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest, record_id, page_id, kind, refers_to))
                    offset += len(member)
                    if offset >= file_bytes:
                        out.close()
                        out = None
                columns = list(zip(*rows))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = bounded(prepared).select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, INDEX)
    return written(index.withColumn("file", F.concat(F.lit(folder + "/"), "file")), "warc-index")


def read(index: DataFrame, payload: bool = True, most_gap: int = 64 << 10, most_read: int = 8 << 20, parts: int | None = None) -> DataFrame:
    """RECORD per row of ``index`` (any selection of its rows): sorted byte ranges, neighbours read at once. A row of the
    index that is named twice is read twice; an empty index gives an empty result."""
    spark = index.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}

        def fetch(file: str, run_of: list[tuple[int, int]]) -> pa.RecordBatch:
            if file not in opened:
                for old in opened.values():
                    old.close()
                opened.clear()
                files, path = open_store(file)
                opened[file] = files.open_input_file(path)
            start, end = run_of[0][0], max(a + n for a, n in run_of)
            data = opened[file].read_at(end - start, start)
            rows = [parse_record(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in run_of]
            return pa.RecordBatch.from_arrays([pa.array([r[c] if c != "payload" or payload else None for r in rows], k) for c, k in zip(names, kinds)], names=names)

        file, waiting, end = None, [], 0
        for batch in batches:
            for f, a, n in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting and (f != file or a - end > most_gap or a + n - waiting[0][0] > most_read):
                    yield fetch(file, waiting)
                    waiting = []
                file, end = f, max(end if waiting else 0, a + n)
                waiting.append((a, n))
        if waiting:
            yield fetch(file, waiting)
        for old in opened.values():
            old.close()

    return dealt.mapInArrow(run, RECORD)
