"""Row types of the engine's tables, versioned by SCHEMA_VERSION. The open bags are meta (strings) and extra (JSON text)."""

from __future__ import annotations

SCHEMA_VERSION = 1

CHUNKS = (
    "schema_version int, chunk_id string, doc_id string, source_uri string, source_mime string, extracted_at string, "
    "page_start bigint, page_end bigint, text string, section_path array<string>, meta map<string,string>, extra string, ord bigint"
)
FILES = (
    "doc_id string, schema_version int, doc_revision bigint, source_uri string, source_mime string, file_size_bytes bigint, "
    "content_sha256 string, page_count bigint, extracted_at string, created_at_meta string, updated_at_meta string, title_guess string, "
    "author_guess string, dominant_lang string, tags array<string>, ingest_tool string, ingest_tool_version string, reader_backend string, "
    "ocr_used boolean, ocr_langs array<string>, chunk_count bigint, total_tokens bigint, meta map<string,string>, extra string"
)
BLOCKS = "doc_id string, ord int, kind string, text string, page_start bigint, page_end bigint, heading_level int, attrs map<string,string>"
VECTORS = "chunk_id string, vec array<float>, dim int, model_id string, text_repr_version string"
POSTINGS = "term string, chunk_id string, dl bigint, tf int, positions array<int>"
#: Columns that a filter key names before it is looked up in meta.
RESERVED = ("doc_id", "chunk_id", "source_uri", "source_mime", "extracted_at", "page_start", "page_end")


def conform(df, ddl: str):
    """df with exactly the columns of ddl: absent ones null, others dropped, types cast."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(ddl).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
