"""Language identification by a linear-chain conditional random field over words.

Each word gets an emission score per language from its character trigrams,
its affixes (two and three letters on either end) and a learned lexicon;
transitions between neighbouring words of a line are learned too. The forward-
backward algorithm labels every word, also in code-switched lines. A
document's language is the one with the largest sum of word posteriors, its
score that sum's mean over the words.

Learned from at most `docs_per_language` documents of each language outside
the held-out fold (those of the smallest hash; whole ones, as far as together
they have at most `chars_per_language` characters), of the `most_languages`
languages with the most documents, and from `train_words` of their words, some
lines of them spliced together from different languages. So what the driver
gets is bounded in rows and in characters. Scoring is one pass over whole
texts without a shuffle; a text of over `batch_chars` characters is taken in
pieces that end at a line (or, in a longer line, at a word) whose sums add up. All lines of a batch are one
sequence whose transitions restart at each line; forward-backward runs over
blocks of it at once by products of transfer matrices, so one long line costs
no more than many short ones.

Defined results: null text and text without letters give `und` and 0; so does
every text if there is nothing to learn from; ties go to the first language by
code point; repeated rows are rows of their own, but a repeated id and language
is learned from once, from its least text; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fold, ship

DOCS_PER_LANGUAGE = 200
CHARS_PER_LANGUAGE = 4_000_000
MOST_LANGUAGES = 400
BATCH_CHARS = 2_000_000
TRAIN_WORDS = 160_000
LEXICON = 1500
BUCKETS = 1 << 15
SEED = 11
UNKNOWN = "und"
_rng = np.random.default_rng(5)
_ODD = _rng.integers(0, 2**63, size=8, dtype=np.uint64) | np.uint64(1)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool)


def _bucket(*parts: np.ndarray, salt: int) -> np.ndarray:
    total = np.full(parts[0].shape, salt * 0x9E3779B9, dtype=np.uint64)
    for odd, part in zip(_ODD, parts, strict=False):
        total = (total ^ part) * odd
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(20)).astype(np.int64) % BUCKETS


class Words:
    """The words of a batch of texts, with the places of their features."""

    def __init__(self, texts: list[str]):
        joined = "\n\n".join(texts)
        codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.concatenate([[10], codes, [10]]).astype(np.uint64)
        inside = _letters()[codes.astype(np.int64)]
        edge = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.count = len(self.starts)
        # lower() can change lengths, so documents are told apart by the lower-cased lengths
        sizes = np.fromiter((len(t.lower()) for t in texts), dtype=np.int64, count=len(texts))
        bounds = 1 + np.cumsum(sizes + 2) - 2
        self.doc = np.searchsorted(bounds, self.starts, side="right")
        lines = np.cumsum(codes == 10)
        line = lines[self.starts] if self.count else np.zeros(0, dtype=np.int64)
        self.reset = np.ones(self.count, dtype=bool)
        self.reset[1:] = line[1:] != line[:-1]
        if not self.count:
            return
        marked = np.where(inside, codes, 0)
        at = np.flatnonzero(inside)
        self.grams = _bucket(marked[at - 1], marked[at], marked[at + 1], salt=1)
        lengths = self.ends - self.starts
        self.gram_starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        first, second = marked[self.starts], marked[self.starts + 1]
        last, before = marked[self.ends - 1], marked[self.ends - 2] * (lengths > 1)
        third = np.where(lengths > 2, marked[np.minimum(self.starts + 2, len(marked) - 1)], 0)
        third_last = np.where(lengths > 2, marked[self.ends - 3], 0)
        self.affixes = [_bucket(first, second, salt=2), _bucket(first, second, third, salt=3), _bucket(before, last, salt=4), _bucket(third_last, before, last, salt=5)]
        place = (at - np.repeat(self.starts, lengths)).astype(np.uint64)
        mixed = (marked[at] + np.uint64(1)) * _ODD[5] ^ (place + np.uint64(1)) * _ODD[6]
        mixed ^= mixed >> np.uint64(31)
        self.keys = np.add.reduceat(mixed * _ODD[7], self.gram_starts)

    def emissions(self, model: dict) -> np.ndarray:
        score = np.add.reduceat(model["grams"][self.grams], self.gram_starts, axis=0) / np.sqrt(self.lengths)[:, None]
        for affix in self.affixes:
            score = score + model["affixes"][affix]
        return score + model["lexicon_weights"][self.lexicon(model)]

    def lexicon(self, model: dict) -> np.ndarray:
        """Place of each word in the lexicon, 0 if it isn't there."""
        known = model["lexicon"]
        at = np.minimum(np.searchsorted(known, self.keys), len(known) - 1)
        return np.where(known[at] == self.keys, at + 1, 0)


def forward_backward(score: np.ndarray, reset: np.ndarray, model: dict, pairs: bool = False):
    """Posteriors of every word; with pairs also the expected counts of transitions and of line starts."""
    n, states = score.shape
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    step, start = np.exp(model["step"]), np.exp(model["start"])
    step, start = step / step.sum(axis=1, keepdims=True), start / start.sum()
    width = max(8, min(512, int(np.sqrt(n))))
    blocks = -(-n // width)
    pad = blocks * width - n
    emit_b = np.concatenate([emit, np.ones((pad, states))]).reshape(blocks, width, states)
    reset_b = np.concatenate([reset, np.ones(pad, dtype=bool)]).reshape(blocks, width)

    def ahead(vectors, k):  # (blocks, any, states) one word on
        moved = vectors @ step
        fresh = vectors.sum(axis=-1, keepdims=True) * start
        vectors = np.where(reset_b[:, k, None, None], fresh, moved) * emit_b[:, k, None, :]
        return vectors / vectors.sum(axis=(-1, -2), keepdims=True)

    def back(vectors, k):  # vectors @ transpose of what ahead() applies
        held = vectors * emit_b[:, k, None, :]
        vectors = np.where(reset_b[:, k, None, None], (held @ start)[..., None] * np.ones(states), held @ step.T)
        return vectors / vectors.sum(axis=(-1, -2), keepdims=True)

    whole = np.broadcast_to(np.eye(states), (blocks, states, states))
    for k in range(width):
        whole = ahead(whole, k)
    alpha, enter = np.full(states, 1 / states), np.empty((blocks, 1, states))
    beta, leave = np.full(states, 1 / states), np.empty((blocks, 1, states))
    for b in range(blocks):
        enter[b, 0] = alpha
        alpha = alpha @ whole[b]
        alpha = alpha / alpha.sum()
    for b in range(blocks - 1, -1, -1):
        leave[b, 0] = beta
        beta = whole[b] @ beta
        beta = beta / beta.sum()
    alphas, betas = np.empty((blocks, width, states)), np.empty((blocks, width, states))
    vector = enter
    for k in range(width):
        vector = ahead(vector, k)
        alphas[:, k] = vector[:, 0]
    vector = leave
    for k in range(width - 1, -1, -1):
        betas[:, k] = vector[:, 0]
        vector = back(vector, k)
    alphas, betas = alphas.reshape(-1, states)[:n], betas.reshape(-1, states)[:n]
    posterior = alphas * betas
    posterior /= posterior.sum(axis=1, keepdims=True)
    if not pairs:
        return posterior
    inner = np.flatnonzero(~reset[1:]) + 1
    joint = alphas[inner - 1][:, :, None] * step[None] * (emit[inner] * betas[inner])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return posterior, joint.sum(axis=0), posterior[reset].sum(axis=0)


def _training_lines(samples: list[tuple[str, str]], languages: list[str], train_words: int, seed: int) -> tuple[list[str], list[list[int]]]:
    """Lines and the language of each of their words; every fourth line is spliced from two languages."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[str]] = {name: [] for name in languages}
    for text, name in samples:
        by[name] += [line for line in text.split("\n") if any(map(str.isalpha, line))]
    cut = lambda line: " ".join((w := line.split(" "))[(i := int(rng.integers(0, max(1, len(w) - 3)))) : i + int(rng.integers(3, 30))])
    lines, spans, words = [], [], 0
    filled = [name for name in languages if by[name]]
    while filled and words < train_words:
        picked = [filled[len(lines) % len(filled)]]
        if len(lines) % 4 == 3:
            picked.append(filled[int(rng.integers(len(filled)))])
        parts = [cut(by[name][int(rng.integers(len(by[name])))]) for name in picked]
        lines.append(parts)
        spans.append([languages.index(name) for name in picked])
        words += sum(p.count(" ") + 1 for p in parts)
    return lines, spans


def fit(samples: list[tuple[str, str]], train_words: int = TRAIN_WORDS, epochs: int = 6, seed: int = SEED, rate: float = 0.25, ridge: float = 1e-6) -> dict | None:
    """The model from (text, language) pairs: gradient steps on the conditional likelihood of the labels."""
    languages = sorted({name for _, name in samples})
    lines, spans = _training_lines(samples, languages, train_words, seed)
    if not lines:
        return None
    states, rng = len(languages), np.random.default_rng(seed)
    batches = []
    for i in range(0, len(lines), 200):
        texts, owners, owner = [], [], 0
        for parts, names in zip(lines[i : i + 200], spans[i : i + 200], strict=True):
            texts.append(" ".join(parts))
            for part, name in zip(parts, names, strict=True):
                owners.append(np.full(Words([part]).count, name, dtype=np.int64))
        words = Words(texts)
        label = np.concatenate(owners)
        if words.count == len(label) and words.count:
            batches.append((words, label))
    if not batches:
        return None
    keys, counts = np.unique(np.concatenate([w.keys for w, _ in batches]), return_counts=True)
    lexicon = np.sort(keys[np.argsort(-counts, kind="stable")[: LEXICON * states]])
    model = {"languages": languages, "lexicon": lexicon, "grams": np.zeros((BUCKETS, states)), "affixes": np.zeros((BUCKETS, states)), "lexicon_weights": np.zeros((len(lexicon) + 1, states)), "step": np.eye(states) * 2.0, "start": np.zeros(states)}
    squares = {name: np.full_like(value, 1e-2) for name, value in model.items() if isinstance(value, np.ndarray) and value.dtype == float}

    def ascend(name, gradient):
        squares[name] += gradient**2
        model[name] += rate * (gradient - ridge * model[name]) / np.sqrt(squares[name])

    def scatter(places, values, size):
        return np.stack([np.bincount(places, weights=values[:, s], minlength=size) for s in range(states)], axis=1)

    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            words, label = batches[b]
            posterior, moves, begins = forward_backward(words.emissions(model), words.reset, model, pairs=True)
            error = -posterior
            error[np.arange(words.count), label] += 1
            error_of_gram = np.repeat(error / np.sqrt(words.lengths)[:, None], words.lengths, axis=0)
            ascend("grams", scatter(words.grams, error_of_gram, BUCKETS))
            ascend("affixes", sum(scatter(affix, error, BUCKETS) for affix in words.affixes))
            ascend("lexicon_weights", scatter(words.lexicon(model), error, len(lexicon) + 1))
            inner = np.flatnonzero(~words.reset[1:]) + 1
            seen = np.zeros((states, states))
            np.add.at(seen, (label[inner - 1], label[inner]), 1.0)
            step = np.exp(model["step"])
            ascend("step", (seen - moves) - step / step.sum(axis=1, keepdims=True) * (seen - moves).sum(axis=1, keepdims=True))
            ascend("start", np.bincount(label[words.reset], minlength=states) - begins)
    for name in ("grams", "affixes", "lexicon_weights"):
        model[name] = model[name].astype(np.float32)
    return model


def pieces_of(text: str, most: int) -> Iterator[str]:
    """text in pieces of at most about `most` characters that end at a line, or else at a word."""
    start = 0
    while len(text) - start > most:
        cut = text.rfind("\n", start + 1, start + most)
        if cut < 0:
            cut = next((i for i in range(start + most, len(text)) if not text[i].isalpha()), len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def predict(texts: list[str | None], model: dict | None, batch_chars: int = BATCH_CHARS) -> tuple[list[str], list[float]]:
    """Language and score of each text; texts, or pieces of long ones, are taken together up to batch_chars characters."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    sums = np.zeros((len(texts), len(model["languages"])))

    def add(owners: list[int], some: list[str]) -> None:
        words = Words(some)
        if words.count:
            posterior = forward_backward(words.emissions(model), words.reset, model)
            each = np.stack([np.bincount(words.doc, weights=posterior[:, s], minlength=len(some)) for s in range(posterior.shape[1])], axis=1)
            np.add.at(sums, owners, each)

    owners, some, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text or "", batch_chars):
            if some and size + len(piece) > batch_chars:
                add(owners, some)
                owners, some, size = [], [], 0
            owners.append(i)
            some.append(piece)
            size += len(piece)
    if some:
        add(owners, some)
    totals = sums.sum(axis=1)
    for d in np.flatnonzero(totals > 0):
        best = int(np.argmax(sums[d]))
        names[d], scores[d] = model["languages"][best], float(min(1.0, sums[d, best] / totals[d]))
    return names, scores


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, train_words: int = TRAIN_WORDS, chars_per_language: int = CHARS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> dict | None:
    ship(docs.sparkSession)
    learned = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    languages = learned.groupBy(F.col("lang").alias("known")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "known").limit(most_languages).select("known")
    rows = learned.select(F.col("doc_id").alias("of_doc"), F.col("lang").alias("of_lang"), F.length("text").alias("size"))
    along = Window.partitionBy("of_lang").orderBy(F.xxhash64("of_doc"), "of_doc", "size")  # limited before the shuffle
    chosen = rows.withColumn("place", F.row_number().over(along)).where(F.col("place") <= docs_per_language)
    chosen = chosen.withColumn("filled", F.sum("size").over(along)).where(F.col("filled") <= chars_per_language)
    chosen = chosen.join(F.broadcast(languages), F.col("of_lang") == F.col("known")).select("of_doc", "of_lang").distinct()
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), (F.col("doc_id") == F.col("of_doc")) & (F.col("lang") == F.col("of_lang")))  # at most docs_per_language * most_languages ids
    got = found.where(F.col("text").isNotNull() & (F.length("text") <= chars_per_language)).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return fit([(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"]))], train_words)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = predict(batch["text"].tolist(), model)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
