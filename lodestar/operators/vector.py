"""Exact vector search by cosine, as a projection and a top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scalars

HIT = "chunk_id string, score double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vec: Column, query: list[float]) -> Column:
    """Cosine with a literal query; its norm is folded on the driver. Null for a zero vector."""
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    q = F.array(*(F.lit(float(x) / norm if norm else 0.0) for x in query))
    return dot(vec, q) / F.nullif(F.sqrt(dot(vec, vec)), F.lit(0.0))


def knn(vectors: DataFrame, query: list[float], top_k: int = 10, key: str = "chunk_id", vec: str = "vec") -> DataFrame:
    """The top_k most similar rows, ties to the smaller key; empty for k = 0. Other dimensions don't match."""
    out = vectors.where(F.size(vec) == len(query)).select(F.col(key), cosine(F.col(vec), query).alias("score")).where("score is not null")
    return out.orderBy(F.col("score").desc(), F.col(key).asc()).limit(max(0, top_k))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros if there are none. Vectors are arrays of one length."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.lit(1), F.size(kept)))


def mean_by(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, dim, mean): mean vector of each group, long form, combined before the shuffle."""
    long = vectors.select(F.col(key), F.posexplode(vec).alias("dim", "x"))
    return long.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def export_table(df: DataFrame, text: str, vec: str, dim: int) -> DataFrame:
    """text and emb_0 .. emb_{dim-1}, six decimals each: the rows of an embedding export; a component that isn't there is null."""
    texts = df.select(F.col(text).alias("text"), scalars.number_texts(F.col(vec), "%.6f").alias("_texts"))
    return texts.select("text", *(F.get("_texts", F.lit(i)).alias(f"emb_{i}") for i in range(dim)))
