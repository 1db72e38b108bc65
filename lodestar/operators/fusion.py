"""Weighted fusion of scored legs. A leg is (key, score); the legs are united and summed, which shuffles each once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scalars

#: leg weights of the fixed presets
PRESET_FIVE = {"tv_and": 0.1, "tv_or": 0.2, "vec": 0.7}
PRESET_NORMALISED = {"tv": None, "tv_and": None, "tv_or": 1.0, "vec": 4.0}


def pivot_legs(legs: dict[str, DataFrame], key: str = "chunk_id", score: str = "score") -> DataFrame:
    """One row per key with a nullable column per leg; a key that a leg has twice counts once, by its best score."""
    rows = [df.select(F.col(key), F.lit(name).alias("_leg"), F.col(score).cast("double").alias("_score")) for name, df in legs.items()]
    every = reduce(DataFrame.unionAll, rows)
    return every.groupBy(key).agg(*(F.max(F.when(F.col("_leg") == name, F.col("_score"))).alias(name) for name in legs))


def hybrid(text: DataFrame, vec: DataFrame, w_text: float = 0.5, w_vec: float = 0.5, top_k: int = 10, key: str = "chunk_id") -> DataFrame:
    """w_text * text + w_vec * vec, a missing leg counting 0."""
    wide = pivot_legs({"text": text, "vec": vec}, key)
    fused = F.lit(w_text) * F.coalesce("text", F.lit(0.0)) + F.lit(w_vec) * F.coalesce("vec", F.lit(0.0))
    return wide.select(key, fused.alias("score"), "text", "vec").orderBy(F.col("score").desc(), F.col(key).asc()).limit(max(0, top_k))


def fuse(wide: DataFrame, weights: dict[str, float | None], mode: str = "hybrid", top_k: int = 10, key: str = "chunk_id", normalise: bool = True) -> DataFrame:
    """Ranked hits of a wide row of leg scores.

    hybrid: sum of weights (divided by their sum) times scores; text: the best
    text leg; vec: the vector leg alone.
    """
    score = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in wide.columns else F.lit(0.0)
    if mode == "text":
        value = F.greatest(*(score(n) for n in ("tv", "tv_and", "tv_or")))
        wide = wide.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in ("tv", "tv_and", "tv_or") if n in wide.columns]))
    elif mode == "vec":
        value, wide = score("vec"), wide.where("vec is not null")
    else:
        total = max(sum(w or 0.0 for w in weights.values()), 1e-6) if normalise else 1.0
        value = reduce(lambda a, b: a + b, [F.lit((w or 0.0) / total) * score(n) for n, w in weights.items()])
    return wide.withColumn("score", value).orderBy(F.col("score").desc(), F.col(key).asc()).limit(max(0, top_k))


def hydrate(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk go. Hits are a top-k, so they are the small side."""
    return chunks.join(F.broadcast(hits), key)


def project_hits(hits: DataFrame) -> DataFrame:
    """What a result list shows: file name, page label and preview."""
    label = F.coalesce(scalars.page_label(F.col("page_start"), F.col("page_end")), scalars.page_label_from_id(F.col("chunk_id")))
    return hits.withColumns({"file": scalars.basename(F.col("source_uri")), "page": label, "preview": scalars.flatten_preview(F.col("text"))})
