"""The engine: ingest, search, delete and context over a store."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.functions import scalars
from lodestar.functions.embedding import Embedder, HashEmbedder, OnnxEmbedder, embed_chunks
from lodestar.operators import filters as flt
from lodestar.operators import fusion, sequence, textsearch, vector
from lodestar.operators.segment import segment_document
from lodestar.plans import templates
from lodestar.plans.config import EngineConfig
from lodestar.plans.store import IndexNotReady, Store
from lodestar.sources import files as sources

__all__ = ["Engine", "IndexNotReady"]


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, embedder: Embedder | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.store = Store(spark, self.config.store_root, self.config.analyzer)
        self.embedder = embedder or self._embedder(self.config)

    @staticmethod
    def _embedder(config: EngineConfig) -> Embedder:
        if config.model_path and config.tokenizer_path:
            return OnnxEmbedder(config.model_path, config.tokenizer_path, dim=config.dim, max_tokens=config.max_tokens, batch=None if config.embed_auto else config.embed_batch_size)
        return HashEmbedder(dim=config.dim, max_chars=max(config.max_tokens, 8192))

    def reconfigure(self, config: EngineConfig) -> bool:
        """Takes over a configuration; True if that made another embedder."""
        key = lambda c: (c.model_path, c.tokenizer_path, c.dim, c.max_tokens, c.embed_auto, c.embed_batch_size)
        changed = key(config) != key(self.config)
        if changed:
            self.embedder = self._embedder(config)
        self.config, self.store = config, Store(self.spark, config.store_root, config.analyzer)
        return changed

    # --- tables ---

    @property
    def chunks(self) -> DataFrame:
        return self.store.chunks

    @property
    def files(self) -> DataFrame:
        return self.store.files

    @property
    def vectors(self) -> DataFrame:
        return self.store.vectors

    @property
    def postings(self) -> DataFrame:
        return self.store.table("postings")

    def match_count(self, clauses: list) -> int:
        """How many chunks a filter matches."""
        return flt.keep(self.chunks, clauses).count()

    def status(self) -> dict:
        manifest = self.store.manifest()
        return {"version": manifest["version"], "text_ready": "postings" in manifest["tables"], "vectors_ready": "vectors" in manifest["tables"], "embedder": self.embedder.model_id}

    def warm_up(self) -> int:
        """Loads the embedder by one text; the dimension of its vector, which has to be the configured one."""
        got = len(self.embedder.embed(["warm-up"])[0])
        if got != self.embedder.dim:
            raise ValueError(f"the embedder gave {got} components, not {self.embedder.dim}")
        return got

    def repo_counts(self) -> dict[str, int]:
        return self.store.counts()

    @contextmanager
    def tagged(self, tag: str):
        """Jobs started inside carry a tag, by which cancel() ends them."""
        self.spark.addTag(tag)
        try:
            yield self
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> list[str]:
        """Ends the running jobs of a tag; the store keeps its last snapshot."""
        return self.spark.interruptTag(tag)

    # --- ingest ---

    @staticmethod
    def _now() -> str:
        return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def ingest_chunks(self, chunks: DataFrame, files: DataFrame | None = None, mode: str = "replace", embed: bool = True) -> int:
        return self.store.upsert(chunks, files, (lambda kept: embed_chunks(kept, self.embedder)) if embed else None, mode)

    def ingest_files(self, path: str | DataFrame, encoding: str = "utf-8", doc_id: str | None = None, mode: str = "replace", pdf_backend=None, at: str | None = None) -> DataFrame:
        """Ingests files below a path, or rows (path, content, size, modified, encoding); returns the rejects with their reasons."""
        files = path if isinstance(path, DataFrame) else sources.read_files(self.spark, path)
        if doc_id and files.limit(2).count() > 1:
            raise ValueError("one doc_id for several files would make them overwrite each other")
        segments, stage = self.store.staged(sources.read_segments(files, self.config.chunk, encoding, pdf_backend), "segments")  # parsed once
        try:
            chunks, records, rejects = sources.to_records(files, segments, at or self._now(), doc_id)
            self.ingest_chunks(chunks, records, mode)
            broken = rejects.collect()  # paths and reasons of unreadable files
        finally:
            self.store._delete(stage)
        return self.spark.createDataFrame(broken, rejects.schema)

    def ingest_text(self, text: str, at: str | None = None) -> str:
        """Ingests one text under an id made from its content; the chunk's id."""
        text = text.strip(scalars.WHITE)
        if not text:
            raise ValueError("the text is empty")
        at = at or self._now()
        one = self.spark.createDataFrame([(text,)], "text string").withColumns({
            "doc_id": F.concat(F.lit("doc-"), F.substring(F.sha2("text", 256), 1, 16)), "source_uri": F.lit("user://input"), "source_mime": F.lit("text/plain"),
            "extracted_at": F.lit(at), "schema_version": F.lit(schema.SCHEMA_VERSION), "ord": F.lit(0),
        }).withColumn("chunk_id", F.concat("doc_id", F.lit("#0")))
        record = one.select("doc_id", "source_uri", "source_mime", "extracted_at", "schema_version", F.sha2("text", 256).alias("content_sha256"), F.octet_length("text").cast("long").alias("file_size_bytes"), F.lit(1).alias("chunk_count"))
        self.ingest_chunks(one, record)
        return one.first()["chunk_id"]

    def preview_chunks(self, path: str, content: bytes, encoding: str = "utf-8") -> list[tuple]:
        """Segments of one file without storing anything."""
        kind, blocks, error = sources.blocks_of_file(path, content, encoding)
        if error:
            raise ValueError(error)
        return segment_document(blocks, self.config.chunk, sources.GROUPING.get(kind, "none"))

    # --- search ---

    def search_text(self, query: str, top_k: int = 10, clauses: list | None = None, fetch_factor: int = 10, mode: str = "parsed", raw_fetch: bool = False) -> DataFrame:
        """Hits with their chunks, best first."""
        at = self.store.pinned()
        hits = textsearch.search(at.text_index(), query, top_k, fetch_factor, clauses, at.chunks, mode, raw_fetch)
        return fusion.project_hits(fusion.hydrate(hits, at.chunks)).orderBy(F.col("score").desc(), "chunk_id")

    def _vector_leg(self, at: Store, query: str, top_k: int, clauses: list | None) -> DataFrame:
        vectors = at.vectors
        if clauses and self.config.strict_filters:
            vectors = vectors.join(flt.keep(at.chunks, clauses).select("chunk_id"), "chunk_id", "left_semi")
        if not (query or "").strip() or top_k <= 0:
            return self.spark.createDataFrame([], vector.HIT)
        return vector.knn(vectors, self.embedder.embed([query])[0], top_k)

    def search_hybrid(self, query: str, top_k: int = 10, clauses: list | None = None, w_text: float = 0.5, w_vec: float = 0.5) -> DataFrame:
        """Weighted sum of the text and the vector leg; one plan, both legs independent."""
        at = self.store.pinned()
        text = textsearch.search(at.text_index(), query, top_k, 10, clauses, at.chunks, raw_fetch=True)
        hits = fusion.hybrid(text, self._vector_leg(at, query, top_k, clauses), w_text, w_vec, top_k)
        return fusion.project_hits(fusion.hydrate(hits.drop("text", "vec"), at.chunks)).orderBy(F.col("score").desc(), "chunk_id")

    def search_multi(self, query: str, top_k: int = 10, weights: dict | None = None, mode: str = "hybrid", clauses: list | None = None) -> DataFrame:
        """Parsed, AND, OR and vector scores side by side, ranked by the weights and the mode."""
        at = self.store.pinned()
        triple = textsearch.triple(at.text_index(), query)
        legs = {name: triple.where(F.col(name).isNotNull()).select("chunk_id", F.col(name).alias("score")) for name in ("tv", "tv_and", "tv_or")}
        wide = fusion.pivot_legs(legs | {"vec": self._vector_leg(at, query, top_k * 10, clauses)})
        if clauses:
            wide = wide.join(flt.keep(at.chunks, clauses).select("chunk_id"), "chunk_id", "left_semi")
        hits = fusion.fuse(wide, weights or fusion.PRESET_NORMALISED, mode, top_k)
        return fusion.project_hits(fusion.hydrate(hits, at.chunks)).orderBy(F.col("score").desc(), "chunk_id")

    def explain_query(self, query: str) -> dict:
        """What each analyzer makes of a query, and how it is parsed."""
        from lodestar.functions.analyze import explain_analyzers
        from lodestar.plans.query_parser import parse

        row = self.spark.range(1).select(*(c.alias(n) for n, c in explain_analyzers(F.lit(query)).items())).first()
        return row.asDict() | {"parsed": parse(query)}

    # --- context and prompts ---

    def neighbor_chunks(self, chunk_id: str) -> tuple[str | None, str | None]:
        doc = self.chunks.where(F.col("chunk_id") == chunk_id).select("doc_id")
        row = sequence.neighbours(self.chunks.join(F.broadcast(doc.limit(1)), "doc_id", "left_semi")).where(F.col("chunk_id") == chunk_id).select("prev_id", "next_id").first()
        return (row["prev_id"], row["next_id"]) if row else (None, None)

    def render_prompt(self, hits: DataFrame, query: str, top_k: int, template: str = "default") -> str:
        """The prompt of a result, with the neighbours' texts around each hit's."""
        chosen = self.config.prompts.by_name[template]
        docs = self.chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
        context = sequence.context_text(docs, chosen.prev, chosen.next).select("chunk_id", "context")
        full = hits.drop("context").join(context, "chunk_id").withColumn("text", F.col("context"))
        row = templates.render(full, chosen, query, top_k).first()
        return row["prompt"] if row else ""

    # --- lists and deletes ---

    def list_files(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return sequence.page(self.files, [F.col("extracted_at").desc(), F.col("doc_id")], limit, offset)

    def list_chunk_ids(self, clauses: list, limit: int = 1000, offset: int = 0) -> DataFrame:
        return sequence.page(flt.keep(self.chunks, clauses), [F.col("doc_id"), F.col("ord"), F.col("chunk_id")], limit, offset).select("chunk_id")

    def get_chunks(self, ids: list[str]) -> DataFrame:
        return sequence.lookup(self.chunks, ids)

    def delete_by_filter(self, clauses: list, batch: int = 1000, allow_all: bool = False) -> dict:
        return self.store.delete(clauses, batch, allow_all)

    def unregistered(self, folder: str) -> DataFrame:
        """Files below folder whose content no record has."""
        known = self.files.select(F.col("file_size_bytes").alias("size"), F.col("content_sha256").alias("sha256"))
        return sequence.unregistered(sources.read_files(self.spark, folder), known).drop("content")
