"""Operators on documents: edge cases, and results against brute force on whole small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, decontam, langid, linededup, mixing, neardup, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, score double, h1 long, place int, words string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def docs_of(spark, texts):
    rows = [(i, t, "en", s, 1, 2, "x", 0.5, 3, 4, "w") for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    """Null and empty texts, null ids and sources, repeated rows, one very long text, non-ASCII."""
    huge = " ".join(f"w{i}" for i in range(30_000))
    return docs_of(spark, [
        (1, LONG, "a"), (2, LONG, "a"), (3, LONG + " more", "b"), (4, None, "b"), (5, "", None), (6, " \n\t", None), (7, huge, "a"), (8, "a b", "c"), (9, "A B", "c"),
        (None, LONG, "a"), (10, "É é x", "d"), (10, "É é x", "d"), (11, "first line of five words here\nfirst line of five words here\nother", "a"), (12, LONG.replace("seven", "7th") + "\n" + LONG, "a"),
    ])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- quality ---


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_edges(spark, edge, nothing):
    for labels in (labels_of(spark, []), labels_of(spark, [(1, 1, 0), (1, 1, 0), (None, 0, 0)])):
        rows = quality.classify(edge, labels).collect()
        assert len(rows) == 14 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert quality.classify(nothing, labels_of(spark, [])).count() == 0
    rows = quality.classify(edge, labels_of(spark, [(i, i % 2, 0) for i in range(1, 13)])).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 13)}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


# --- mixing ---


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        room = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and room * weight[s] / share > 3 * sizes[s] + 1e-9} if share else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else room * weight[s] / share for s in order}
        capped |= over


@pytest.mark.parametrize("which", ["edge", "real"])
def test_mix_targets(request, which):
    docs = request.getfixturevalue(which)
    rows, again = mixing.mix(docs).collect(), mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += count(r.text)
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    known = {r.doc_id: r.source for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        source = known[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= mixing.BLOCK_WORDS


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


def test_sainte_lague_equals_the_plain_method(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 7}
    parties = spark.createDataFrame([(0, k, float(v), n) for n in (1, 7, 100) for k, v in votes.items()], "one int, key string, votes double, seats long").withColumn("one", F.col("seats"))
    for n in (1, 7, 100):
        quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() for k in range(n) if v), key=lambda x: x)[:n]
        want = Counter(p for _, p in quotients)
        got = {r.key: r.won for r in mixing.sainte_lague(parties, "one", "key", "votes", "seats").where(F.col("seats") == n).collect()}
        assert got == {p: want[p] for p in votes}


# --- near-duplicates ---


def brute_near(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("limit", [neardup.REGION_LIMIT, 2])
def test_near_duplicates_edges(edge, nothing, limit):
    rows = neardup.near_duplicates(edge, 3, 85, region_limit=limit).collect()
    want = brute_near([(r.doc_id, r.text) for r in edge.collect() if r.doc_id is not None], 3, 85)
    assert len(rows) == 14
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == {(i, *v) for i, v in want.items()}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(nothing, 3, 85).count() == 0


def test_near_duplicates_of_documents(real):
    some = real.where("doc_id < 200")
    want = brute_near([(r.doc_id, r.text) for r in some.collect()], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(some, 3, 85).collect()} == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}


# --- line dedup ---


def within_one(a, b):
    i = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = min(len(a), len(b)) - i
    j = next((n for n in range(rest) if a[-1 - n] != b[-1 - n]), rest)
    return max(len(a), len(b)) - i - j <= 1


def brute_lines(rows, min_words=1, near_words=10):
    at = sorted((i, p, line.strip(" \t\r")) for i, t in rows for p, line in enumerate((t or "").split("\n")))
    judged = [(i, p, x.split(" ")) for i, p, x in at if x and x.count(" ") + 1 >= min_words]
    gone, seen = set(), []
    for i, p, words in judged:
        if any(w == words or len(words) >= near_words and len(w) >= near_words and within_one(w, words) for w in seen):
            gone.add((i, p))
        seen.append(words)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_line_dedup(spark, edge, nothing):
    some = edge.where("doc_id is not null and doc_id <> 10 and doc_id <> 7")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(some).collect()} == brute_lines([(r.doc_id, r.text) for r in some.collect()])
    words = LONG.split()
    variants = [" ".join(words[:i] + words[i + 1 :]) for i in range(0, 20, 3)] + [" ".join(words[:i] + ["new"] + words[i:]) for i in range(0, 21, 4)] + [" ".join(words[:i] + ["new"] + words[i + 1 :]) for i in range(0, 20, 2)]
    variants += [v + " tail" for v in variants[:5]] + [" ".join(reversed(words)), LONG]
    docs = docs_of(spark, [(n, v, "s") for n, v in enumerate(variants)])
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == brute_lines(list(enumerate(variants)))
    out = linededup.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_removed"] and out.count() == 14
    assert {(r.n_lines, r.text) for r in out.where("doc_id = 4").collect()} == {(0, None)}
    assert [r.text for r in out.where("doc_id = 10").collect()] == ["É é x"] * 2
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_documents(real):
    some = real.where("doc_id < 60")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(some).collect()} == brute_lines([(r.doc_id, r.text) for r in some.collect()])


# --- decontamination ---


def brute_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = defaultdict(set)
    for i, t in items:
        words = split(t)
        n = min(10, len(words))
        for j in range(len(words) - n + 1 if words and i is not None else 0):
            windows[tuple(words[j : j + n])].add(str(i))
    out = []
    for i, t in docs:
        words, hit, found = split(t), set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(words) - n + 1):
                if (w := tuple(words[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[w]
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, LONG), (2, "x " + LONG + " y"), (3, "first line"), (4, "É é"), (5, None), (6, ""), (None, "a b"), (20, "other"), (1, "É é x")]


def test_decontamination(spark, edge, nothing, sf_dir, real):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = lambda docs, b: sorted((tuple(r[c] for c in columns) for r in decontam.decontaminate(docs, b).collect()), key=str)
    assert rows(edge, items) == brute_hits([(r.doc_id, r.text) for r in edge.collect()], ITEMS)
    assert not any(r[-1] for r in rows(edge, items.where("false"))) and rows(nothing, items) == []
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert rows(real, bench) == brute_hits([(r.doc_id, r.text) for r in real.collect()], [(r.item_id, r.text) for r in bench.collect()])


# --- personal data ---

NAIVE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_spans(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            keep = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if keep:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(NAIVE).index(s[2])))


TEXTS = [None, "", "a@b.c d@e", "1.2.3.4.5.6.7.8 and 999.1.1.1", "4111 1111 1111 1111 +1 (743) 555-3824", "x@y.z@w.v", "+49 30 1234567 4785380592391139", "é 127.0.0.1 \U0001f600 a.b@c-d.org.", "9" * 5000 + " " + "a" * 5000 + "@", "john [at] mail [dot] org or (555) 123-4567", "Version 2.0 of 12"]


def test_personal_data(spark, real):
    model = pii.train()
    rows = pii.detect(docs_of(spark, [(i, t, "s") for i, t in enumerate(TEXTS)]).unionByName(real.select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True), model).collect()
    said = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    texts = defaultdict(set)
    for i, t in [*enumerate(TEXTS), *((r.doc_id, r.text) for r in real.collect())]:
        base = naive_spans(t or "")
        n = Counter(k for *_, k in base)
        texts[i].add((n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said(base).encode()).hexdigest(), said(base)))
    for r in rows:
        match = [b for b in texts[r.doc_id] if b[:5] == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)]
        assert match and any(set(filter(None, b[5].split(","))) <= set(r.spans.split(",")) for b in match)
    assert pii.find(TEXTS[9], model) == ([], [(0, 24, "email"), (28, 42, "phone")])
    assert pii.find(TEXTS[10], model) == ([], [])


# --- language ---


def test_language_edges(spark, edge, nothing):
    rows = langid.identify(edge, None).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)} and len(rows) == 14
    model = langid.train(edge.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")), train_words=500)
    rows = {r.doc_id: r for r in langid.identify(edge, model).collect()}
    assert rows[4].lang_pred == rows[5].lang_pred == rows[6].lang_pred == "und" and rows[1].lang_pred in ("en", "xx")
    assert langid.train(nothing) is None and langid.identify(nothing, model).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    score, step, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    reset = np.array([True, False, False, True, False, False, False])
    move, begin = np.exp(step) / np.exp(step).sum(1, keepdims=True), np.exp(start) / np.exp(start).sum()
    total = np.zeros((7, 3))
    for path in itertools.product(range(3), repeat=7):
        p = np.exp(sum(score[t, y] for t, y in enumerate(path)))
        for t, y in enumerate(path):
            p *= begin[y] if reset[t] else move[path[t - 1], y]
        for t, y in enumerate(path):
            total[t, y] += p
    got = langid.forward_backward(score, reset, {"step": step, "start": start})
    assert np.allclose(got, total / total.sum(1, keepdims=True))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def crowd_of(n, seed=5, words=100):
    """Distinct near copies of one template: families of a few edits each, and a few edits of each copy's own."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(words)]

    def edited(base, edits, tag):
        out = list(base)
        for place in rng.sample(range(words), edits):
            out[place] = f"{tag}{place}"
        return out

    families = [edited(template, 3, f"f{f}x") for f in range(max(1, n // 20))]
    return [(i, " ".join(edited(families[rng.randrange(len(families))], rng.choice((1, 2, 2, 3)), f"d{i}x"))) for i in range(n)]


@pytest.mark.parametrize("limit", [2, neardup.REGION_LIMIT])
def test_near_duplicates_of_a_crowd(spark, monkeypatch, limit):
    """In a crowd round one template every link is found, whatever the blocks and also where runs are salted."""
    monkeypatch.setattr(neardup.crowd_links, "__defaults__", (64, 32))
    rows = crowd_of(400)
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85, region_limit=limit, reach=1).collect()}
    assert got == brute_near(rows, 3, 85)


def test_components_of_nothing_and_of_null_ends(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 2), (3, 3), (5, 4), (5, 4), (4, 5)], "a long, b long")
    assert sorted(map(tuple, components.components(odd).collect())) == [(4, 4), (5, 4)]
