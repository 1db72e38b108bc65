"""Exact top-k search by inner product with a pivot-distance index.

Vectors become integers, floor(64 * x) of each component. With M the largest
norm, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0) turn the inner product into a
distance: |q' - v'|^2 = |q|^2 + M^2 - 2 q.v. The index keys each v' by its
nearest of `pivots` pivots and by its distance to it, cut into annuli: `rings`
of them a pivot, and with the number of vectors up to MOST_RINGS. By the
triangle inequality |d(q', p) - d(v', p)| <= |q' - v'|, an annulus bounds the
score of all it holds. A query sorts the annuli by their bounds and expands
along that order in rounds, `budgets` vectors further each time; the k-th
score found so far is its floor, which rises from round to round, and it stops
at the first annulus that is bounded below it. The result is exact.

Annuli are cut into blocks of about `block_rows` vectors by a hash of the id,
so one very common vector spreads over many blocks, and blocks into groups of
SPREAD; the queries of an annulus come in packs. Packs meet blocks by annulus
and group, so the keys of that join grow with the vectors. A task multiplies a
pack by a block and keeps k scores per query. Pivots come from a bounded
sample (`pivot_sample` vectors of the smallest hash), the bounds and counts of
annuli (at most pivots * MOST_RINGS rows) from all vectors; only these reach
the driver.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null vec_id; shorter vectors count as padded
with zeros; of equal scores the smaller vec_id goes first; a query is not its
own candidate, by vec_id; repeated rows are candidates of their own, and of
the query rows of one vec_id the least vector is the query; an empty table
gives no rows; other columns are ignored. Scores of products beyond 2^53 are
not exact, and components beyond 2^57 count as 2^57.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import forget, ship, stored

PIVOTS, RINGS, MOST_RINGS = 16, 8, 256
RING_ROWS = 1 << 14
PIVOT_SAMPLE = 2000
BLOCK_ROWS = 2048
SPREAD = 16
PACK = 256
#: vectors that a round looks at for each query; the first takes what holds k of them, the last all that the floor leaves
BUDGETS = (0, 32 * BLOCK_ROWS, None)


def quantised(vectors: DataFrame) -> DataFrame:
    """id and v (array of long, floor(64 * x)) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 64)).alias("v"))


def _matrix(arrays, dim: int) -> np.ndarray:
    out = np.zeros((len(arrays), dim))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def choose_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Farthest-first centres of the sample, moved to the means of their members a few times."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(pivots, len(sample)) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    centres = sample[picked]
    for _ in range(rounds):
        nearest = np.argmin(((sample[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
        centres = np.stack([sample[nearest == p].mean(axis=0) if (nearest == p).any() else centres[p] for p in range(len(centres))])
    return centres


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


class Index:
    """Pivots, cell bounds and the norm bound; small, whatever the number of vectors."""

    def __init__(self, pivots: np.ndarray, norm: float, dim: int):
        self.pivots, self.norm, self.dim = pivots, norm, dim
        self.cells: pd.DataFrame = pd.DataFrame()

    def lifted(self, points: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(points)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (points**2).sum(axis=1)))
        return np.hstack([points, last[:, None]])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each cell's vectors."""
        d = _distances(self.lifted(queries, True), self.pivots)[:, self.cells["pivot"].to_numpy()]
        low, high = self.cells["low"].to_numpy()[None], self.cells["high"].to_numpy()[None]
        gap = np.maximum(0.0, np.maximum(low - d, d - high))
        return ((queries**2).sum(axis=1)[:, None] + self.norm**2 - gap**2) / 2 * (1 + 1e-9) + 1e-3


def build(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = PIVOT_SAMPLE, block_rows: int = BLOCK_ROWS) -> tuple[Index, DataFrame, DataFrame]:
    """The index, the blocks (cell, part, ids, packed vectors) of all vectors, and in_cell and n_blocks; a part holds up to SPREAD blocks."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = vectors.agg(F.max(square).alias("norm"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim = max(1, stats["dim"] or 1)
    rings = min(max(rings, MOST_RINGS), max(rings, -(-stats["n"] // (pivots * RING_ROWS))))
    index = Index(np.zeros((1, dim + 1)), float(np.sqrt(stats["norm"] or 0.0)), dim)
    some = vectors.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()  # at most `sample` rows
    index.pivots = choose_pivots(index.lifted(_matrix([r["v"] for r in some], dim), False), pivots)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(index.lifted(_matrix(batch["v"], dim), False), index.pivots)
            pivot = d.argmin(axis=1)
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "pivot": pivot, "distance": d[np.arange(len(d)), pivot]})

    keyed = stored(vectors.mapInPandas(near, "id long, v array<long>, pivot int, distance double"), "keyed")
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("distance", [i / rings for i in range(1, rings)], 1000).alias("cuts"))
    cuts = stored(cuts.select(F.col("pivot").alias("of_pivot"), "cuts"), "cuts")
    placed = keyed.join(F.broadcast(cuts), F.col("pivot") == F.col("of_pivot"))  # at most `pivots` rows
    placed = placed.withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("distance"))))
    placed = placed.withColumn("cell", F.col("pivot") * rings + F.col("ring")).drop("of_pivot", "cuts")
    cells = placed.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n"))
    cells = stored(cells, "cells")  # at most pivots * rings rows
    index.cells = pd.DataFrame([r.asDict() for r in cells.collect()], columns=["cell", "pivot", "low", "high", "n"]).sort_values("cell", ignore_index=True)
    sizes = cells.select(F.col("cell").alias("in_cell"), F.ceil(F.col("n") / block_rows).alias("n_blocks"))
    blocks = placed.join(F.broadcast(sizes), F.col("cell") == F.col("in_cell")).withColumn("block", F.pmod(F.xxhash64("id", "distance"), "n_blocks"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [int(group["cell"].iloc[0])], "part": [int(group["block"].iloc[0]) // SPREAD], "ids": [group["id"].to_numpy("int64").tobytes()], "vectors": [_matrix(group["v"], dim).tobytes()]})

    packed = blocks.select("cell", "block", "id", "v").groupBy("cell", "block").applyInPandas(pack, "cell int, part long, ids binary, vectors binary")
    packed = stored(packed, "blocks")
    forget(keyed)
    return index, packed, sizes


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _searched(wanted: DataFrame, blocks: DataFrame, sizes: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, vec, score) of the k best of every block for wanted(query, v, floor, cell)."""
    pack = PACK

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def full(cell):
            rows = held.pop(cell)
            return pd.DataFrame({"of_cell": [cell], "queries": [np.array([r[0] for r in rows], dtype="int64").tobytes()], "matrix": [_matrix([r[1] for r in rows], dim).tobytes()], "floors": [np.array([r[2] for r in rows], dtype=float).tobytes()]})

        for batch in batches:
            for query, v, floor, cells in zip(batch["query"], batch["v"], batch["floor"], batch["cells"], strict=True):
                for cell in cells:
                    rows = held.setdefault(int(cell), [])
                    rows.append((query, v, floor))
                    if len(rows) >= pack:
                        yield full(int(cell))
        for cell in list(held):
            yield full(cell)

    packs = wanted.mapInPandas(packed, "of_cell int, queries binary, matrix binary, floors binary")
    packs = packs.join(F.broadcast(sizes), F.col("of_cell") == F.col("in_cell"))
    packs = packs.withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_blocks") - 1) / SPREAD))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queries, matrix, floors, ids, vectors in zip(*(batch[c] for c in ("queries", "matrix", "floors", "ids", "vectors")), strict=True):
                queries, ids, floors = np.frombuffer(queries, "int64"), np.frombuffer(ids, "int64"), np.frombuffer(floors)
                scores = np.frombuffer(matrix).reshape(-1, dim) @ np.frombuffer(vectors).reshape(-1, dim).T
                out = []
                for i, query in enumerate(queries):
                    fit = np.flatnonzero((scores[i] >= floors[i]) & (ids != query))
                    fit = fit[_best(ids[fit], scores[i][fit], k)]
                    out.append((np.full(len(fit), query), ids[fit], scores[i][fit]))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pd.DataFrame({"query": columns[0].astype("int64"), "vec": columns[1].astype("int64"), "score": columns[2].astype("int64")})

    met = packs.join(blocks, (F.col("of_cell") == F.col("cell")) & (F.col("of_part") == F.col("part"))).select("queries", "matrix", "floors", "ids", "vectors")
    return met.mapInPandas(search, "query long, vec long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, budgets: tuple = BUDGETS, **options) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of vectors(vec_id, embedding) for each row of queries."""
    ship(vectors.sparkSession)
    index, blocks, sizes = build(quantised(vectors), **options)
    asked = quantised(queries).groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("query"), "v")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec")
    found, state = None, asked.select("query", "v", F.lit(float("-inf")).alias("floor"), F.lit(0).alias("done"))
    for budget in budgets:
        plan = stored(state.mapInPandas(_expansion(index.bounds, index.cells, index.dim, k, budget), "query long, v array<long>, floor double, done int, cells array<int>"), "expansion")
        more = _searched(plan.select("query", "v", "floor", "cells"), blocks, sizes, index.dim, k)
        every = more if found is None else found.unionAll(more)
        best_now = stored(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "vec", "score"), "found")
        floors = best_now.groupBy(F.col("query").alias("of_query")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
        state = plan.join(floors, F.col("query") == F.col("of_query"), "left").select("query", "v", floor.alias("floor"), "done")
        forget(found)
        found = best_now
    rank = F.row_number().over(best)
    return found.select(F.col("query").alias("query_id"), rank.cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")


def _expansion(bounds_of, cells: pd.DataFrame, dim: int, k: int, budget: int | None, rows: int = 256):
    """Which annuli each query of (query, v, floor, done) looks at next: those behind the first `done` in the order of their bounds."""
    number, held = cells["cell"].to_numpy(), cells["n"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch) if len(number) else 0, rows):
                some = batch.iloc[i : i + rows].reset_index(drop=True)
                bounds = bounds_of(_matrix(some["v"], dim))
                order = np.argsort(-bounds, axis=1, kind="stable")
                place, done = np.arange(len(number))[None], some["done"].to_numpy()[:, None]
                ahead = np.cumsum(np.where(place >= done, held[order], 0), axis=1) - np.where(place >= done, held[order], 0)
                take = (place >= done) & (np.take_along_axis(bounds, order, axis=1) >= some["floor"].to_numpy()[:, None])
                if budget is not None:
                    take &= ahead < max(budget, k + 1)  # k candidates besides the query itself
                yield pd.DataFrame({"query": some["query"], "v": some["v"], "floor": some["floor"], "done": some["done"] + take.sum(axis=1), "cells": [number[o[t]].tolist() for o, t in zip(order, take, strict=True)]})

    return run
