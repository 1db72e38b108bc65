"""WARC archives: a writer of one gzip member per record, and a sequential reader.

Writing: each task streams its rows into `.warc.gz` files in a folder that all
executors share, starts another file at `file_bytes`, and returns the names of
the files it has closed. Names are unique to the attempt, so a task that is
run again after a lost executor writes other files and those of the lost
attempt are named nowhere. Reading: each task streams files from start to end,
with one member decompressed at a time in steps of `CHUNK` bytes, records
framed by Content-Length and block and payload digests verified; memory is
bounded by the largest record.

Files are opened through the file systems of pyarrow, by the folder's URI
(file, hdfs, s3, gs).

Revisits: of the pages with equal payloads of at least `min_bytes` bytes, that
with the largest page_id is the response and the others are revisits of it,
without a payload of their own. Digests are computed by Spark and only they
and the ids are grouped, with the maxima combined before the shuffle.

Defined results: null html is an empty payload; null ids come before all
others; rows with the response's own id and payload are responses too;
repeated rows are rows of their own; other columns are ignored. A record that
is cut short or fails a digest raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import shared_path, ship, stored

FILE_BYTES = 256 << 20
CHUNK = 1 << 16
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
RECORD_COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record, as a gzip member of its own."""
    headers = {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", **headers, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    headers = {
        "WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n"), "Content-Type": "text/html; charset=utf-8",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "X-Payload-Length": str(len(payload)),
    }
    if is_revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to)}
    return record_bytes(headers, b"" if is_revisit else payload)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a stream of gzip members, in order."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        member, data, head, size = zlib.decompressobj(31), bytearray(), None, None
        while not member.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise ValueError("archive ends inside a record")
            data += member.decompress(rest, CHUNK)
            rest = member.unconsumed_tail or member.unused_data
            if head is None and (end := data.find(b"\r\n\r\n")) >= 0:
                first, *lines = bytes(data[:end]).decode().split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError("record without a WARC version line")
                head = dict(line.split(": ", 1) for line in lines)
                size, start = int(head["Content-Length"]), end + 4
        if head is None or len(data) != start + size + 4 or data[-4:] != b"\r\n\r\n":
            raise ValueError("record's length is not its Content-Length")
        block = bytes(data[start : start + size])
        if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {head.get('WARC-Record-ID')} doesn't match")
        if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != head["WARC-Block-Digest"]:
            raise ValueError(f"payload digest of {head.get('WARC-Record-ID')} doesn't match")
        yield head, block


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html plus refers_to (of revisits) and is_revisit."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    latest = full.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n"))
    latest = stored(latest.where("n > 1").select(F.col("digest").alias("of_digest"), "latest"), "latest")
    joined = full.join(latest, F.col("digest") == F.col("of_digest"), "left")
    is_revisit = F.col("of_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return joined.select("page_id", "url", "html", F.when(is_revisit, F.col("latest")).alias("refers_to"), is_revisit.alias("is_revisit"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows of with_revisits(); (path, records, bytes) of each file, read again from the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers_to, is_revisit in zip(*(batch[c].tolist() for c in ("page_id", "url", "html", "refers_to", "is_revisit")), strict=True):
                if out is None:
                    path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = system.open_output_stream(path, compression=None), 0, 0  # members are packed already
                whole = lambda i: None if pd.isna(i) else int(i)
                member = page_record(whole(page_id), url, html.encode("utf-8", "surrogatepass"), whole(refers_to), is_revisit)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size]})

    rows = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stored(rows.mapInPandas(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files in archives(path): RECORD_COLUMNS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(folder)
        number = lambda text: text.removeprefix("<urn:page:").removesuffix(">") or None
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for head, _ in read_records(stream):
                        rows.append((number(head["WARC-Record-ID"]), head["X-Payload-Length"], head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number(head.get("WARC-Refers-To", ""))))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 2, "path")
    text = rows.mapInPandas(run, ", ".join(f"{n} string" for n in names))
    return text.withColumns({n: F.col(n).cast("long") for n in ("page_id", "payload_bytes", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages as archives and reads them back."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "warc")
    return read_archives(write_archives(with_revisits(pages, min_bytes), folder, file_bytes), folder)
