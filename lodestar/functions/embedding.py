"""Embedders: a protocol, a deterministic hash embedder in Catalyst, and an optional ONNX one in an iterator pandas UDF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class InputTooLong(ValueError):
    """A text has more tokens (or characters) than the model takes."""


class Embedder(Protocol):
    model_id: str
    dim: int

    def column(self, text: Column) -> Column: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Each component from -1 to 1, from the hash of model, component and text. No Python runs for a column of texts."""

    model_id: str = "hash-1"
    dim: int = 64
    max_chars: int = 8192

    def column(self, text: Column) -> Column:
        one = lambda i: ((F.xxhash64(F.lit(self.model_id), i, text).cast("double") + 9223372036854775808.0) / 18446744073709551615.0 * 2 - 1).cast("float")
        long = F.raise_error(F.lit(f"a text has over {self.max_chars} characters")).cast("array<float>")
        return F.when(F.length(text) > self.max_chars, long).otherwise(F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), one))

    def embed(self, texts: list[str]) -> list[list[float]]:
        from pyspark.sql import SparkSession

        if any(len(t) > self.max_chars for t in texts):
            raise InputTooLong(f"a text has over {self.max_chars} characters")
        if not texts:
            return []
        rows = SparkSession.getActiveSession().createDataFrame(list(enumerate(texts)), "i int, text string")
        return [list(r["v"]) for r in rows.select("i", self.column(F.col("text")).alias("v")).orderBy("i").collect()]


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens whose mask is 1; zeros where there are none; no normalisation."""
    if hidden.ndim != 3 or hidden.shape[:2] != mask.shape:
        raise ValueError(f"the model gave shape {hidden.shape} for masks {mask.shape}")
    weight = mask.astype(hidden.dtype)[:, :, None]
    return (hidden * weight).sum(axis=1) / np.maximum(1, weight.sum(axis=1))


def length_batches(lengths: list[int], most: int, first: int = 128, least: int = 8) -> Iterator[list[int]]:
    """Places in batches of similar length, shortest first; the caller sends back a batch's success (True) or failure.

    A failure halves the batch size (below `least` it is an error), a success doubles it up to `first`.
    """
    order, size = sorted(range(len(lengths)), key=lambda i: lengths[i]), first
    at = 0
    while at < len(order):
        near = [i for i in order[at : at + size] if lengths[i] <= lengths[order[at]] + max(1, most // 4)]
        ok = yield near
        if ok is False:
            if size <= least:
                raise RuntimeError(f"a batch of {least} failed")
            size = max(least, size // 2)
        else:
            at += len(near)
            size = min(first, size * 2)


def fixed_batches(lengths: list[int], size: int) -> Iterator[list[int]]:
    """Places in batches of one size, in order; a failed batch is an error."""
    for at in range(0, len(lengths), max(1, size)):
        if (yield list(range(at, min(len(lengths), at + max(1, size))))) is False:
            raise RuntimeError(f"a batch of {size} failed")


@dataclass(frozen=True)
class OnnxEmbedder:
    """A model and tokenizer file from outside; masked mean pooling. Loaded once per Python worker.

    batch: a fixed number of texts a batch; None takes texts of similar length
    together, and fewer after a failure.
    """

    model_path: str
    tokenizer_path: str
    model_id: str = "onnx"
    dim: int = 768
    max_tokens: int = 8192
    pad: str = "<pad>"
    batch: int | None = None

    def __post_init__(self):
        if self.dim < 1 or self.max_tokens < 1 or (self.batch is not None and self.batch < 1):
            raise ValueError("dim, max_tokens and batch are at least 1")

    def _load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.tokenizer_path)
        if tokenizer.token_to_id(self.pad) is None:
            raise ValueError(f"the tokenizer has no {self.pad}")
        return onnxruntime.InferenceSession(self.model_path), tokenizer

    def _run(self, session, tokenizer, texts: list[str]) -> np.ndarray:
        ids = [tokenizer.encode(t).ids for t in texts]
        if any(len(i) > self.max_tokens for i in ids):
            raise InputTooLong(f"a text has over {self.max_tokens} tokens")
        width, pad = max(1, *map(len, ids)), tokenizer.token_to_id(self.pad)
        padded = np.array([i + [pad] * (width - len(i)) for i in ids], dtype=np.int64)
        mask = np.array([[1] * len(i) + [0] * (width - len(i)) for i in ids], dtype=np.int64)
        feed = {"input_ids": padded, "attention_mask": mask, "token_type_ids": np.zeros_like(padded)}
        hidden = session.run(None, {k: v for k, v in feed.items() if k in {i.name for i in session.get_inputs()}})[0]
        out = pool(np.asarray(hidden), mask)
        if out.shape != (len(texts), self.dim):
            raise ValueError(f"the model gave {out.shape}, not {(len(texts), self.dim)}")
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._run(*self._load(), texts).tolist() if texts else []

    def column(self, text: Column) -> Column:
        @F.pandas_udf(ArrayType(FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            session, tokenizer = self._load()
            for texts in batches:
                values, out = texts.fillna("").tolist(), [None] * len(texts)
                sizes = [len(v) for v in values]
                plan = length_batches(sizes, self.max_tokens) if self.batch is None else fixed_batches(sizes, self.batch)
                try:
                    near = next(plan)
                    while True:
                        try:
                            for i, vector in zip(near, self._run(session, tokenizer, [values[i] for i in near]), strict=True):
                                out[i] = vector.tolist()
                            near = plan.send(True)
                        except (MemoryError, RuntimeError):
                            near = plan.send(False)
                except StopIteration:
                    yield pd.Series(out, index=texts.index)

        return run(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """Vector rows of all chunks."""
    return chunks.select(F.col(key).alias("chunk_id"), embedder.column(F.col(text)).alias("vec"), F.lit(embedder.dim).alias("dim"), F.lit(embedder.model_id).alias("model_id"), F.lit("text-1").alias("text_repr_version"))
