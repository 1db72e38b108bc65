"""Inverted index and BM25, as DataFrames.

The index is postings (term, chunk_id, dl, tf, positions) with doclen. A
query's terms are literals, so the filter on term reaches the scan of a stored
index, and only the matching postings are read; they carry their chunk's
length. An index that isn't stored keeps each chunk's tokens in one row, and
only tokens of the query leave it. Scores are exact BM25 with k1 = 1.2 and
b = 0.75; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import analyze
from lodestar.operators import filters as flt
from lodestar.plans.query_parser import parse
from lodestar.session import spread

K1, B = 1.2, 0.75
HIT = "chunk_id string, score double, raw_score double"


@dataclass
class TextIndex:
    """postings and doclen tables, and the analyzer that made them; tokens (chunk_id, dl, tokens) where it isn't stored."""

    postings: DataFrame
    doclen: DataFrame
    analyzer: str = "words"
    tokens: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        """One row: n documents and their mean length."""
        # the ids are counted so that this reads the columns that scoring reads, and Spark deals rows out once for both
        return self.doclen.agg(F.count("chunk_id").alias("n_docs"), F.avg("dl").alias("avg_dl"))

    def terms_of(self, text: str) -> list[str]:
        spark = self.postings.sparkSession
        return spark.range(1).select(analyze.ANALYZERS[self.analyzer](F.lit(text)).alias("t")).first()["t"] or []

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of these terms."""
        if self.tokens is None:
            return self.postings.where(F.col("term").isin(*sorted(set(terms))))
        placed = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("position")))
        wanted = F.filter(placed, lambda x: x["term"].isin(*sorted(set(terms))))
        return _postings(self.tokens.select("chunk_id", "dl", F.explode_outer(wanted).alias("at")).where("at is not null").select("chunk_id", "dl", "at.*"))


def _postings(at: DataFrame) -> DataFrame:
    """Postings of tokens (chunk_id, dl, term, position)."""
    return at.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


#: tokens (and rows) whose postings are sorted together, and bytes of them, about; postings that go out at a time
TOKENS_AT_ONCE, BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 21, 64 << 20, 1 << 16


def _ranks(values: pa.Array) -> np.ndarray:
    """The place of each value among the sorted ones."""
    out = np.empty(len(values), np.int64)
    out[pc.array_sort_indices(values).to_numpy()] = np.arange(len(values))
    return out


def _placed(chunks: DataFrame) -> DataFrame:
    """Postings of chunks (chunk_id, texts: the token lists of one or more texts), each made from its own row: no token is a row, none is shuffled.

    They come in runs, of the chunks of TOKENS_AT_ONCE tokens each (one at
    least), that are sorted by term and chunk.
    """
    most, most_bytes, most_rows = TOKENS_AT_ONCE, BYTES_AT_ONCE, ROWS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0  # the rows of a run, their tokens and bytes
        for batch in batches:
            texts = batch.column("texts")
            per_text = texts.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            tokens = np.concatenate([[0], np.cumsum(per_text)])[ends] + np.arange(1, len(ends) + 1)  # up to the end of each row, which counts as one
            at = 0
            while at < len(ends):
                before = int(tokens[at - 1]) if at else 0
                to = int(np.searchsorted(tokens, before + most - n, side="right"))
                if to > at or not held:
                    to = max(to, at + 1)
                    held.append(batch.slice(at, to - at))
                    n, size, at = n + int(tokens[to - 1]) - before, size + held[-1].nbytes, to
                if at < len(ends) or n >= most or size >= most_bytes:
                    yield from postings_of(held)
                    held, n, size = [], 0, 0
        if held:
            yield from postings_of(held)

    def postings_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        texts = batch.column("texts")
        lists = texts.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = lists.flatten()
        if not len(tokens):
            return
        row_of_text = np.repeat(np.arange(len(batch)), texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        row, place = np.repeat(row_of_text, sizes), np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        coded = tokens.dictionary_encode()
        code = coded.indices.to_numpy()
        key = _ranks(coded.dictionary)[code] * len(batch) + _ranks(batch.column("chunk_id"))[row]
        order = np.argsort(key, kind="stable")  # places stay in order
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(first, len(key)).astype(np.int32)
        head = order[first]
        place = place[order].astype(np.int32)
        for i in range(0, len(first), most_rows):
            part, to = head[i : i + most_rows], ends[i : i + most_rows + 1]
            rows = pa.array(row[part])
            places = pa.ListArray.from_arrays(pa.array(to - to[0]), pa.array(place[to[0] : to[-1]]))
            columns = [coded.dictionary.take(pa.array(code[part])), batch.column("chunk_id").take(rows), batch.column("dl").take(rows), pa.array(np.diff(to)), places]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["term", "chunk_id", "dl", "tf", "positions"]
    key = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "dl", "texts").mapInArrow(run, f"term string, chunk_id {key}, dl bigint, tf int, positions array<int>")


def build(chunks: DataFrame, analyzer: str = "words", text: str = "text", key: str = "chunk_id", unique: bool = False) -> TextIndex:
    """The index of all chunks; unique: no key stands twice, and the scan has parts enough.

    Postings are made within a chunk's row. Where keys may repeat, texts (not
    their tokens) are brought together by key first.
    """
    rows = chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("text"))
    split = analyze.ANALYZERS[analyzer]
    tokens = (rows if unique else spread(rows)).select("chunk_id", split(F.col("text")).alias("tokens"))
    tokens = tokens.select("chunk_id", F.size("tokens").cast("long").alias("dl"), "tokens")
    if unique:
        whole = tokens.select("chunk_id", "dl", F.array("tokens").alias("texts"))
    else:
        whole = rows.repartition("chunk_id").groupBy("chunk_id").agg(F.collect_list("text").alias("t")).select("chunk_id", F.transform("t", split).alias("texts"))
        whole = whole.select("chunk_id", F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.size(t)).alias("dl"), "texts")
    return TextIndex(_placed(whole), tokens.select("chunk_id", "dl"), analyzer, tokens)


def empty_hits(spark) -> DataFrame:
    return spark.createDataFrame([], HIT)


def logistic(raw: Column) -> Column:
    return 1 / (1 + F.exp(-raw))


def clause_weights(index: TextIndex, clauses: list[list[str]]) -> DataFrame:
    """(clause, chunk_id, w): the BM25 weight of every chunk that a clause, a term or a phrase of terms, matches.

    A phrase counts its places in the chunk and has the sum of its terms' rarities.
    """
    spark = index.postings.sparkSession
    rows = [(n, term, i, len(terms)) for n, terms in enumerate(clauses) for i, term in enumerate(terms)]
    places = spark.createDataFrame(rows, "clause int, term string, offset int, width int")  # as many rows as the query has terms
    some = index.of_terms([term for _, term, _, _ in rows])
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(index.stats)  # one row
    idf = df.join(stats).select("term", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    rarity = places.join(F.broadcast(idf), "term").groupBy("clause").agg(F.sum("idf").alias("idf"), F.first("avg_dl").alias("avg_dl"))
    found = some.join(F.broadcast(places), "term")
    counted = found.where("width = 1").select("clause", "chunk_id", "dl", F.col("tf").cast("long").alias("tf"))
    if any(len(terms) > 1 for terms in clauses):
        starts = found.where("width > 1").select("clause", "chunk_id", "dl", "width", "offset", F.explode("positions").alias("position"))
        starts = starts.groupBy("clause", "chunk_id", "dl", "width", (F.col("position") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n = width")
        counted = counted.unionByName(starts.groupBy("clause", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf")))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))
    return counted.join(F.broadcast(rarity), "clause").select("clause", "chunk_id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("w"))


def score_terms(index: TextIndex, terms: list[str], require_all: bool) -> DataFrame:
    """(chunk_id, raw_score) over the terms: any of them, or all."""
    terms = sorted(set(terms))
    hits = clause_weights(index, [[t] for t in terms]).groupBy("chunk_id").agg(F.sum("w").alias("raw_score"), F.count(F.lit(1)).alias("matched"))
    if require_all:
        hits = hits.where(F.col("matched") == len(terms))
    return hits.select("chunk_id", "raw_score")


def phrase_matches(index: TextIndex, terms: list[str]) -> DataFrame:
    """(chunk_id) where the terms stand one after the other."""
    return clause_weights(index, [terms]).select("chunk_id")


def search(index: TextIndex, query: str, top_k: int = 10, fetch_factor: int = 10, clauses: list | None = None, chunks: DataFrame | None = None, mode: str = "parsed", raw_fetch: bool = False) -> DataFrame:
    """Hits (chunk_id, score, raw_score), best first.

    mode: `parsed` (the search syntax), `and`, `or`. Filters never change a
    score: they are semi-joins before the top-N, or after it for clauses that
    say so. raw_fetch keeps all top_k * fetch_factor hits.
    """
    spark = index.postings.sparkSession
    if top_k <= 0 or not (query or "").strip():
        return empty_hits(spark)
    hits = parsed_scores(index, query) if mode == "parsed" else None
    if mode != "parsed":
        terms = index.terms_of(query)
        hits = score_terms(index, terms, mode == "and") if terms else None
    if hits is None:
        return empty_hits(spark)
    before, after = flt.split(clauses or [])
    if before:
        hits = hits.join(flt.keep(chunks, before).select("chunk_id"), "chunk_id", "left_semi")
    order = [F.col("raw_score").desc(), F.col("chunk_id").asc()]
    hits = hits.orderBy(*order).limit(max(top_k * fetch_factor, top_k))
    if after:
        hits = hits.join(flt.keep(chunks, after).select("chunk_id"), "chunk_id", "left_semi")
    out = hits.select("chunk_id", logistic(F.col("raw_score")).alias("score"), "raw_score").orderBy(*order)
    return out if raw_fetch else out.limit(top_k)


def clauses_of(index: TextIndex, query: str) -> list[tuple[str, list[str]]]:
    """(occur, terms) of each clause of a query; a word of several terms is a phrase, one of none is no clause."""
    made = [(c.occur, index.terms_of(c.text)) for c in parse(query).clauses]
    made = [(occur, terms) for occur, terms in made if terms]
    return made if any(occur != "must_not" for occur, _ in made) else []


def _judged(occurs: list[str], first: int = 0) -> tuple[Column, Column]:
    """Of the clauses first, first + 1, ...: the score as an aggregate, and whether the chunk is a hit.

    Required clauses have all to match, forbidden ones not to; without required
    ones, one optional clause has to. Optional clauses add to the score.
    """
    numbers = {kind: [first + n for n, occur in enumerate(occurs) if occur == kind] for kind in ("must", "should", "must_not")}
    n = lambda kind: F.sum(F.col("clause").isin(*numbers[kind]).cast("int")) if numbers[kind] else F.lit(0)
    hit = (n("must") == len(numbers["must"])) & (n("must_not") == 0)
    if not numbers["must"]:
        hit &= n("should") > 0
    return F.sum(F.when(F.col("clause").isin(*numbers["must"], *numbers["should"]), F.col("w"))), hit


def parsed_scores(index: TextIndex, query: str) -> DataFrame | None:
    """(chunk_id, raw_score) of the search syntax, in one aggregate over the clauses' hits."""
    clauses = clauses_of(index, query)
    if not clauses:
        return None
    weights = clause_weights(index, [terms for _, terms in clauses])
    raw, hit = _judged([occur for occur, _ in clauses])
    return weights.groupBy("chunk_id").agg(raw.alias("raw_score"), hit.alias("hit")).where("hit").select("chunk_id", "raw_score")


def triple(index: TextIndex, query: str) -> DataFrame:
    """(chunk_id, tv, tv_and, tv_or): the parsed, AND and OR scores from one pass over the postings."""
    spark = index.postings.sparkSession
    terms = sorted(set(index.terms_of(query))) if (query or "").strip() else []
    if not terms:
        return spark.createDataFrame([], "chunk_id string, tv double, tv_and double, tv_or double")
    clauses = clauses_of(index, query)
    weights = clause_weights(index, [[t] for t in terms] + [c for _, c in clauses])
    raw, _ = _judged(["should"] * len(terms))
    parsed, hit = _judged([occur for occur, _ in clauses], len(terms)) if clauses else (F.lit(None), F.lit(False))
    matched = F.sum((F.col("clause") < len(terms)).cast("int"))
    hits = weights.groupBy("chunk_id").agg(raw.alias("raw"), matched.alias("matched"), F.when(hit, parsed).cast("double").alias("parsed"))
    tv_or = logistic(F.col("raw"))
    return hits.select("chunk_id", logistic(F.col("parsed")).alias("tv"), F.when(F.col("matched") == len(terms), tv_or).alias("tv_and"), tv_or.alias("tv_or"))
