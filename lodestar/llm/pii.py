"""Personal data: fixed base patterns, and a semi-Markov CRF that adds spans.

Base spans are the matches of four patterns with their checks. The CRF reads
the stretches of words around digits, `@` and spelled-out "at" and "dot" that
no base span covers, and splits each into segments: single outside words or
entities (email, ip, card, phone) of at most MAX_TOKENS words. A segment's
score is a sum of weights of whole-span features (its shape, its digits and
separators, the checks it passes once disguises are undone, the word before
it); with the transition weights, bounded-entity dynamic programming chooses
boundaries and types together. It finds what the patterns can't: addresses
with [at] and [dot], national phone numbers, cards with other separators.

The model is trained here, on seeded sentences built from templates, by
gradient steps on the conditional likelihood (semi-Markov forward-backward).
Whole texts are read in one pass without a shuffle; texts without a digit, an
`@` or a spelled-out sign cost one scan.

Defined results: null text counts as empty; no spans give the digest of the
empty string; added spans never overlap base spans or each other; base spans
of different kinds may overlap; repeated rows are rows of their own; other
columns are ignored. n_email, n_ip, n_card and n_phone count base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, UPPER, ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
MAX_TOKENS = 6
CONTEXT = 2
SEED = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_SPELLED = ("[at]", "(at)", "{at}", "<at>", "[dot]", "(dot)", "{dot}", "<dot>", " dot ")
_DIGIT = re.compile(r"[0-9]")
_ASCII = str.maketrans(UPPER, LOWER)  # keeps every character's place
PART = 200


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:  # each @ once: the longest run of local characters before it, a domain after it
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_TOKEN = re.compile(r"\S+")
_SHAPE = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"))
_AT, _DOT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", re.I), re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+", re.I)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_LOCAL_PHONE = re.compile(r"\(?0?[0-9]{2,5}\)?[ ./-][0-9]{2,4}(?:[ ./-]?[0-9]{2,5}){1,4}")


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Words of text[start:end] without the punctuation at their ends."""
    out = []
    for m in _TOKEN.finditer(text, start, end):
        word = m.group()
        left = len(word) - len(word.lstrip("\"'*#$%&,;:!?|"))
        right = len(word.rstrip("\"'*#$%&.,;:!?|"))
        out.append((m.start() + left, m.start() + max(left, right)))
    return out


def segment_features(text: str, words: list[tuple[int, int]], i: int, n: int) -> tuple[str, ...]:
    """Names of the features of the segment of n words from word i on."""
    span = text[words[i][0] : words[i + n - 1][1]]
    if n == 1 and not any(c in span for c in "0123456789@[](){}<>") and span.lower() not in ("at", "dot"):
        return ("plain",)
    shape = span[:80]
    for pattern, to in _SHAPE:
        shape = pattern.sub(to, shape)
    digits = re.sub("[^0-9]", "", span)
    undone = _DOT.sub(".", _AT.sub("@", span))
    before = text[words[i - 1][0] : words[i - 1][1]].lower() if i else "^"
    out = [f"n{n}", f"shape:{shape}", f"digits:{min(len(digits), 20)}", f"before:{before}"]
    if span != undone:
        out.append("disguised")
    if _MAIL.fullmatch(undone):
        out.append("is-mail")
    if _QUAD.fullmatch(undone) and all(int(p) <= 255 for p in undone.split(".")):
        out.append("is-quad")
    if 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9]+(?:[ ./_-][0-9]+)*", span):
        out.append("is-card")
    if 9 <= len(digits) <= 15 and _LOCAL_PHONE.fullmatch(span) and "is-quad" not in out:
        out.append("is-phone")
    if len(out) == 4 + ("disguised" in out):
        out.append("is-nothing")
    return tuple(out)


class Model:
    """Weights by (feature, label) and between labels."""

    def __init__(self):
        self.weights: dict[tuple[str, int], float] = {}
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def lattice(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(end, length, features) of every segment that may be one."""
        return [(i + n, n, segment_features(text, words, i, n)) for i in range(len(words)) for n in range(1, min(MAX_TOKENS, len(words) - i) + 1)]

    def scores(self, lattice) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for end, n, names in lattice:
            score = np.array([sum(self.weights.get((f, y), 0.0) for f in names) for y in range(len(LABELS))])
            if n > 1:
                score[0] = -np.inf  # outside words stand alone
            out[end, n] = score
        return out

    def best(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Entities (first word, number of words, kind) of the best segmentation."""
        score = self.scores(self.lattice(text, words))
        total, back = [np.zeros(len(LABELS))], [None]
        for end in range(1, len(words) + 1):
            here, how = np.full(len(LABELS), -np.inf), [None] * len(LABELS)
            for n in range(1, min(MAX_TOKENS, end) + 1):
                step = total[end - n][:, None] + (self.moves if end > n else 0) + score[end, n][None]
                came = step.argmax(axis=0)
                for y in range(len(LABELS)):
                    if step[came[y], y] > here[y]:
                        here[y], how[y] = step[came[y], y], (n, int(came[y]))
            total.append(here)
            back.append(how)
        out, end, y = [], len(words), int(np.argmax(total[-1]))
        while end > 0:
            n, came = back[end][y]
            if y:
                out.append((end - n, n, LABELS[y]))
            end, y = end - n, came
        return out[::-1]

    def step(self, text: str, words: list[tuple[int, int]], gold: list[tuple[int, int, int]], lattice, rate: float) -> None:
        """One gradient step; gold: (end, length, label) of each segment in order."""
        score, states = self.scores(lattice), range(len(LABELS))
        size = len(words)
        sums = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        ahead = [np.full(len(LABELS), -np.log(len(LABELS)))]
        for end in range(1, size + 1):
            ahead.append(sums(np.stack([sums(ahead[end - n][:, None] + (self.moves if end > n else 0), 0) + score[end, n] for n in range(1, min(MAX_TOKENS, end) + 1)]), 0))
        behind = [np.zeros(len(LABELS)) for _ in range(size + 1)]
        for at in range(size - 1, 0, -1):
            behind[at] = sums(np.stack([sums(self.moves + (score[at + n, n] + behind[at + n])[None], 1) for n in range(1, min(MAX_TOKENS, size - at) + 1)]), 0)
        whole = sums(ahead[size], 0)
        expected = {}
        moves = np.zeros_like(self.moves)
        for end, n, names in lattice:
            joint = ahead[end - n][:, None] + (self.moves if end > n else 0) + score[end, n][None] + behind[end][None] - whole
            joint = np.exp(np.minimum(joint, 0))
            if end > n:
                moves -= joint
            for y in states:
                if (p := joint[:, y].sum()) > 1e-6:
                    for f in names:
                        expected[f, y] = expected.get((f, y), 0.0) - p
        names_of, last = {(end, n): names for end, n, names in lattice}, None
        for end, n, y in gold:
            for f in names_of[end, n]:
                expected[f, y] = expected.get((f, y), 0.0) + 1.0
            if last is not None:
                moves[last, y] += 1
            last = y
        for key, gradient in expected.items():
            self.weights[key] = self.weights.get(key, 0.0) * (1 - 1e-4) + rate * gradient
        self.moves += rate * moves


def _example(rng: np.random.Generator) -> tuple[str, list[tuple[str, int]]]:
    """Pieces of a sentence with their labels, as text and (piece, label)."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    d = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    w = lambda: "".join(pick("an", "er", "tion", "th", "ou", "de", "la", "os", "ein", "sch", "ment", "re") for _ in range(int(rng.integers(1, 4))))

    def card(n: int) -> str:
        body = pick("4", "5", "3") + d(n - 2)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def entity() -> tuple[str, int]:
        kind = int(rng.integers(1, 5))
        if kind == 1:
            at, dot = pick((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), ("(at)", "(dot)"), (" {at} ", "."))
            return w() + pick("", f".{w()}", d(2)) + at + w() + pick("", d(1)) + dot + pick("com", "org", "net", "de"), 1
        if kind == 2:
            return pick("[.]", "(.)", "[dot]").join(str(int(x)) for x in rng.integers(0, 256, 4)), 2
        if kind == 3:
            digits, sep = card(16), pick(".", "/", "_")
            return pick(sep.join(digits[i : i + 4] for i in range(0, 16, 4)), card(13)), 3
        return pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(7)}", f"({d(3)}) {d(3)} {d(4)}"), 4

    def other() -> list[tuple[str, int]]:
        kind = int(rng.integers(8))
        if kind == 0:
            return [(pick("2.0", "version", "4.0", "3", "1", "12:30", "2024-05-01", "v1.2.3", "10,000", "3.14", "1.2.3.4.5"), 0)]
        if kind == 1:
            return [(pick(d(4), d(7), d(10), d(12), d(16), d(24)), 0)] if not luhn(x := d(16)) else [(d(5), 0)]
        if kind == 2:
            return [("".join(pick(*"0123456789abcdef") for _ in range(40)), 0)]
        if kind == 3:
            return [(".".join(str(int(x)) for x in rng.integers(256, 999, 4)), 0)]
        if kind == 4:
            return [("at", 0), (w(), 0), (pick("dot", "of", "the"), 0)]
        if kind == 5:
            return [(f"{w()}@{w()}", 0)]
        if kind == 6:
            return [(f"[{d(1)}]", 0), (f"({d(4)})", 0)]
        return [(d(3), 0), (d(3), 0), (w(), 0)]

    pieces: list[tuple[str, int]] = []
    for _ in range(int(rng.integers(2, 4))):
        pieces += [(w(), 0) for _ in range(int(rng.integers(1, 4)))]
        pieces += [entity()] if rng.random() < 0.5 else other()
    pieces += [(w(), 0)]
    return " ".join(p for p, _ in pieces), pieces


@cache
def train(examples: int = 260, epochs: int = 4, seed: int = SEED, rate: float = 0.2) -> Model:
    """The model, made once in a process: the same arguments give the same weights."""
    rng, model, data = np.random.default_rng(seed), Model(), []
    for _ in range(examples):
        text, pieces = _example(rng)
        words, gold, place, w = tokens(text, 0, len(text)), [], 0, 0
        for piece, label in pieces:
            n = len(piece.split())
            gold += [(w + n, n, label)] if label else [(w + 1, 1, 0)]
            w, place = w + n, place + len(piece) + 1
        if w == len(words) and all(n <= MAX_TOKENS for _, n, _ in gold):
            data.append((text, words, gold, model.lattice(text, words)))
    for epoch in range(epochs):
        for i in rng.permutation(len(data)):
            model.step(*data[i], rate / (1 + epoch))
    return model


def _entities(text: str, words: list[tuple[int, int]], model: Model, part: int = PART) -> list[tuple[int, int, str]]:
    """The entities of a stretch, of any length, from overlapping parts of `part` words.

    A part decides on the entities that start 2 * MAX_TOKENS or more words before
    its end, so none is cut; the next part begins MAX_TOKENS words before what is
    still open, so that it sees what stands there.
    """
    out, start = [], 0
    while start < len(words):
        first = max(0, start - MAX_TOKENS)
        some = words[first : start + part]
        last = start + part >= len(words)
        open_from = len(words) if last else start + part - 2 * MAX_TOKENS
        for a, n, kind in model.best(text, some):
            if start <= first + a < open_from:
                out.append((some[a][0], some[a + n - 1][1], kind))
                if not last:
                    open_from = max(open_from, first + a + n)
        start = open_from
    return out


def _lowered(text: str) -> str:
    """text with A-Z lower-cased at the same places: lower() where it keeps the length, as it nearly always does, else letter by letter."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII)


def added_spans(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """What the CRF adds: entities in the stretches around signs that no base span covers."""
    signs = [m.start() for m in _SIGN.finditer(text)]
    low = _lowered(text)
    for s in _SPELLED:
        at = low.find(s)
        while at >= 0:
            signs.append(at + (s[0] == " "))
            at = low.find(s, at + 1)
    covered = sorted((s, e) for s, e, _ in base)
    signs, c, free = sorted(signs), 0, []
    reach = 0
    for at in signs:
        while c < len(covered) and covered[c][0] <= at:
            reach = max(reach, covered[c][1])
            c += 1
        if at >= reach:
            free.append(at)
    if not free:
        return []
    ends = [e for _, e in covered]
    out, done = [], 0
    for at in free:
        if at < done:
            continue
        # a stretch: CONTEXT words beyond the outer signs, on one line, between base spans
        left, right, k = at, at, at
        for side in (-1, 1):
            words, k = 0, at
            while 0 <= k < len(text) and text[k] != "\n" and words <= CONTEXT:
                if side > 0 and text[k].isspace() and k + 1 < len(text) and not text[k + 1].isspace():
                    ahead = _TOKEN.match(text, k + 1).group()
                    words = 0 if _SIGN.search(ahead) or ahead.lower().strip("[](){}<>.,") in ("at", "dot") else words + 1
                elif side < 0 and text[k].isspace():
                    words += 1
                if words <= CONTEXT:
                    left, right = (min(left, k), right) if side < 0 else (left, max(right, k + 1))
                k += side
        left = max([left, done, *(e for e in ends if e <= at)])
        right = min([right, *(s for s, _ in covered if s > at)])
        done = max(done, right)
        words = [x for x in tokens(text, left, right) if x[1] > x[0]]
        out += _entities(text, words, model)
    return [s for s in out if not any(s[0] < e and b < s[1] for b, e in covered)]


def find(text: str | None, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text."""
    text = text or ""
    if not _SIGN.search(text):
        low = _lowered(text)
        if not any(s in low for s in _SPELLED):
            return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of each document."""
    ship(docs.sparkSession)
    model = model or train()
    said = lambda spans: ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find(t, model) for t in batch["text"]]
            columns = {"doc_id": batch["doc_id"]} | {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
            yield pd.DataFrame(columns | {"base_sha256": [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found], "spans": [said(every) for _, every in found]})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(run, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
