"""File sources: folder scans, format dispatch, and files to blocks, chunks and file records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestar import schema
from lodestar.functions import scalars
from lodestar.operators import pdftext
from lodestar.operators.segment import SegmentParams, segment_document, text_blocks
from lodestar.session import spread
from lodestar.sources import office, pdf

#: extensions read as plain text
TEXT_EXTENSIONS = ("txt", "md", "markdown", "csv", "tsv", "log", "json", "yaml", "yml", "ini", "toml", "cfg", "conf", "rst", "tex", "srt", "properties")
MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pdf": "application/pdf", "text": "text/plain",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
}
#: grouping that no chunk of a format crosses
GROUPING = {"docx": "levels", "pptx": "h1", "xlsx": "h1", "ods": "h1"}


def is_text_like(path: Column, content: Column) -> Column:
    """True for a text extension, or no extension and no NUL among the first 2048 bytes."""
    ext = scalars.extension(path)
    return ext.isin(*TEXT_EXTENSIONS) | ((ext == "") & (F.instr(F.hex(F.substring(content, 1, 2048)), "00") == 0))


def format_of(path: Column, content: Column) -> Column:
    """pdf, docx, pptx, xlsx, ods, text, or null for what no reader takes."""
    ext = scalars.extension(path)
    return F.when(ext.isin("pdf", "docx", "pptx", "xlsx", "ods"), ext).when(is_text_like(path, content), "text")


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, max_depth: int | None = None, preview: int = 48) -> DataFrame:
    """path, size, modified and depth of the files below folder, and a preview where one is asked for.

    Without a preview the contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bare = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    root = re.sub(bare, "", folder).rstrip("/")
    below = F.substring(F.regexp_replace("path", bare, ""), len(root) + 1, 1 << 30)
    depth = F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit(""))) - 1
    out = files.withColumn("depth", depth)
    if extensions and "*" not in extensions:
        out = out.where(scalars.extension(F.col("path")).isin(*(e.lower().lstrip(".") for e in extensions)))
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "depth"]
    if preview:
        text = F.when(is_text_like(F.col("path"), F.col("content")), scalars.decode(F.substring("content", 1, 4096)))
        columns.append(scalars.flatten_preview(text, preview).alias("preview"))
    return out.select(*columns)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, modified, size, content) of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def blocks_of_file(path: str, content: bytes, encoding: str = "utf-8", pdf_backend=None) -> tuple[str | None, list[dict], str | None]:
    """(format, blocks, error) of one file. pdf_backend is a function from bytes to page texts, `none`, or `text` (the default)."""
    ext = path.rpartition("/")[2].rpartition(".")
    ext = ext[2].lower() if ext[1] and ext[0] else ""
    readers = {"docx": office.read_docx, "pptx": office.read_pptx, "xlsx": office.read_xlsx, "ods": office.read_xlsx}
    try:
        if ext in readers:
            return ext, readers[ext](content), None
        if ext == "pdf":
            if pdf_backend == "none":
                return None, [], "no PDF reader is set"
            pages = [pdftext.normalise_page(p) for p in (pdf_backend if callable(pdf_backend) else pdf.read_pages)(content)]
            return "pdf", [b for n, p in enumerate(pages, 1) for b in pdftext.page_blocks(p, n)], None
        if ext in TEXT_EXTENSIONS or ext == "" and b"\0" not in content[:2048]:
            return "text", text_blocks(decode_bytes(content, encoding)), None
    except Exception as error:  # a broken file is a row of the report, not the end of the job
        return None, [], f"{type(error).__name__}: {error}"
    return None, [], f"no reader for .{ext}"


def decode_bytes(content: bytes, encoding: str = "utf-8", strict: bool = False) -> str:
    names = {"shift_jis": "cp932", "sjis": "cp932", "windows-31j": "cp932", "cp932": "cp932", "windows-1252": "cp1252", "cp1252": "cp1252", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
    return content.decode(names.get(encoding.lower(), "utf-8"), "strict" if strict else "replace").removeprefix("﻿")


#: characters of text, about, that go out together, and the most rows
TEXT_AT_ONCE, ROWS_AT_ONCE = 8 << 20, 20_000


def _of_files(files: DataFrame, rows: Callable[[str, bytes, str | None], Iterator[tuple]], ddl: str) -> DataFrame:
    """The rows that a function makes of each file(path, content), a file at a time; rows of many files go out together."""
    kind = to_arrow_schema(StructType.fromDDL(ddl))
    at = kind.get_field_index("text")
    most, most_rows = TEXT_AT_ONCE, ROWS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
        for batch in batches:
            for i in range(len(batch)):
                for row in rows(*(batch.column(c)[i].as_py() for c in ("path", "content", "encoding"))):
                    held.append(row)
                    size += len(row[at] or "")
                    if size >= most or len(held) >= most_rows:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    label = F.col("encoding") if "encoding" in files.columns else F.lit(None).cast("string")
    return spread(files.select("path", "content", label.alias("encoding"))).mapInArrow(run, ddl)


_BLOCKS = "path string, format string, error string, ord int, kind string, text string, page_start long, page_end long, heading_level int, attrs map<string,string>"


def read_blocks(files: DataFrame, encoding: str = "utf-8", pdf_backend=None) -> DataFrame:
    """Blocks of files(path, content), in order; a file without blocks gives one row with its error.

    A column `encoding` in files overrides the default for each file.
    """

    def rows(path: str, content: bytes, label: str | None) -> Iterator[tuple]:
        kind, blocks, error = blocks_of_file(path, content, label or encoding, pdf_backend)
        for i, b in enumerate(blocks):
            yield path, kind, error, i, *(b.get(c) for c in ("kind", "text", "page_start", "page_end", "heading_level")), list((b.get("attrs") or {}).items())
        if not blocks:
            yield path, kind, error, *[None] * 7

    return _of_files(files, rows, _BLOCKS)


_SEGMENTS = "path string, format string, error string, pos long, text string, page_start long, page_end long"


def read_segments(files: DataFrame, params: SegmentParams = SegmentParams(), encoding: str = "utf-8", pdf_backend=None) -> DataFrame:
    """Segments of files(path, content): reading and segmenting are one pass, a file at a time."""

    def rows(path: str, content: bytes, label: str | None) -> Iterator[tuple]:
        kind, blocks, error = blocks_of_file(path, content, label or encoding, pdf_backend)
        parts = segment_document(blocks, params, GROUPING.get(kind, "none")) if blocks else []
        yield from [(path, kind, error, i, *s) for i, s in enumerate(parts)] or [(path, kind, error, None, None, None, None)]

    return _of_files(files, rows, _SEGMENTS)


def to_records(files: DataFrame, segments: DataFrame, extracted_at: str, doc_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, files, rejects) of read files and their segments."""
    name = F.lit(doc_id) if doc_id else F.col("path")
    mime = F.coalesce(*(F.when(F.col("format") == k, v) for k, v in MIME.items()))
    good = segments.where(F.col("pos").isNotNull() & scalars.is_valid_chunk(F.col("text")))
    chunks = good.select(
        F.lit(schema.SCHEMA_VERSION).alias("schema_version"), F.concat_ws("#", "path", F.col("pos").cast("string")).alias("chunk_id"), name.alias("doc_id"), F.col("path").alias("source_uri"),
        mime.alias("source_mime"), F.lit(extracted_at).alias("extracted_at"), "page_start", "page_end", "text", F.col("pos").alias("ord"),
    )
    facts = good.groupBy("path", "format").agg(F.max("page_end").alias("page_count"), F.count(F.lit(1)).alias("chunk_count"))
    known = files.select("path", "size", "modified", F.sha2("content", 256).alias("sha256"))  # contents are not joined
    records = known.join(facts, "path").select(
        name.alias("doc_id"), F.lit(schema.SCHEMA_VERSION).alias("schema_version"), F.col("path").alias("source_uri"), mime.alias("source_mime"), F.col("size").alias("file_size_bytes"),
        F.col("sha256").alias("content_sha256"), "page_count", F.lit(extracted_at).alias("extracted_at"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at_meta"),
        F.col("format").alias("reader_backend"), "chunk_count",
    )
    rejects = segments.where(F.col("error").isNotNull()).select("path", F.col("error").alias("reason")).distinct()
    return schema.conform(chunks, schema.CHUNKS), schema.conform(records, schema.FILES), rejects


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records, one JSON object a line; a broken line ends the job. Unknown keys, and those of `extra`, go to extra."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = F.from_json("value", schema.CHUNKS.replace(", extra string", "").replace(", ord bigint", ""), {"mode": "FAILFAST"})
    known = [c.split()[0] for c in schema.CHUNKS.split(", ")]
    everything = F.from_json("value", "map<string,string>")
    loose = F.map_filter(everything, lambda k, v: ~k.isin(*known))
    nested = F.from_json(F.try_element_at(everything, F.lit("extra")), "map<string,string>")
    extra = F.map_concat(loose, F.coalesce(nested, F.create_map().cast("map<string,string>")))
    rows = lines.select(whole.alias("r"), F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra"))
    return schema.conform(rows.select("r.*", "extra"), schema.CHUNKS)


def write_ndjson(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_one_column_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True, drop_empty: bool = True) -> DataFrame:
    """`text`: the trimmed first column. With header, the first line of every file is one, whatever its names."""
    name = "windows-31j" if encoding.lower() in ("shift_jis", "sjis", "cp932") else encoding
    raw = spark.read.csv(path, header=header, encoding=name, multiLine=True, inferSchema=False, escape='"', enforceSchema=True)
    first = F.col(f"`{raw.columns[0]}`") if raw.columns else F.lit(None).cast("string")
    out = raw.select(scalars.strip(F.regexp_replace(F.coalesce(first, F.lit("")), "^\ufeff", "")).alias("text"))
    return out.where("text <> ''") if drop_empty else out


def preview_text(content: bytes, encoding: str = "utf-8", most: int = 256 << 10) -> str:
    return decode_bytes(content[:most], encoding).replace("\r", "")


def read_one_column_workbook(files: DataFrame, header: bool = True) -> DataFrame:
    """(path, pos, text): the cells of the first column of each workbook's first sheet; empty ones are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                cells = office.first_column(content, header)
                yield pd.DataFrame({"path": [path] * len(cells), "pos": range(len(cells)), "text": cells}, columns=["path", "pos", "text"]).astype({"pos": "int64"})

    return files.select("path", "content").mapInPandas(run, "path string, pos long, text string")


def column_to_chunks(rows: DataFrame, extracted_at: str) -> DataFrame:
    """Rows of one column as chunks: each is a document of its own, numbered within its source."""
    doc = F.concat(F.lit("excel-"), F.substring(F.sha2(F.concat_ws("#", "path", F.col("pos").cast("string")), 256), 1, 16))
    return schema.conform(
        rows.select(F.lit(schema.SCHEMA_VERSION).alias("schema_version"), F.concat(doc, F.lit("#0")).alias("chunk_id"), doc.alias("doc_id"), F.concat(F.lit("excel://"), F.col("pos").cast("string")).alias("source_uri"), F.lit("text/plain").alias("source_mime"), F.lit(extracted_at).alias("extracted_at"), "text", F.lit(0).alias("ord")),
        schema.CHUNKS,
    )


#: sort keys of a scanned list
SCAN_SORTS = {"path": "path", "size": "size", "modified": "modified", "depth": "depth"}


def sort_scan(scanned: DataFrame, by: str = "path", descending: bool = False) -> DataFrame:
    """A scan's rows by path, size, modified, depth or ext, ties by path."""
    key = scalars.extension(F.col("path")) if by == "ext" else F.col(SCAN_SORTS[by])
    return scanned.orderBy(key.desc() if descending else key.asc(), "path")


def write_embedding_export(table: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """An export_table() as CSV with a header, written as one folder of part files."""
    table.write.option("header", "true").option("encoding", encoding).mode("errorifexists").csv(path)


def embedding_workbooks(table: DataFrame, rows_per_book: int = 100_000) -> DataFrame:
    """(part, content) of an export_table() as workbooks of at most rows_per_book rows, each with a header."""
    names = table.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[str]] = []
        book = lambda rows: pd.DataFrame({"content": [office.write_workbook([names, *rows])]})
        for batch in batches:
            for row in batch[names].itertuples(index=False):
                held.append(list(row))
                if len(held) >= rows_per_book:
                    yield book(held)
                    held = []
        if held:
            yield book(held)

    return table.mapInPandas(run, "content binary").select(F.monotonically_increasing_id().alias("part"), "content")
