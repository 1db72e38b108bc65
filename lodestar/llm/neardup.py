"""Near-duplicate detection by an LSH forest over MinHash signatures.

A document's set is its distinct k-word shingles (fewer words: the whole
sequence). Equal sets are one node. A node's signature of 128 minima is read
in 16 rotations; rotation t is its label in tree t, and each tree is a sorted
order of labels. A region is a common prefix of 4 values (at 0.85 one tree
shows a pair with probability 0.52, 16 trees miss it with 1e-5).

Regions are laid out in runs, stretches of their order that one task sorts. A
region of up to `region_limit` nodes is one run. A larger one is cut between
prefixes two values longer than what all its labels share, again and again
where a stretch is still too large, until every stretch fits: the depth follows
the region's density. Nodes that
agree in all values are in the order of their digest and are cut there.
Candidates are the `reach` longest-common-prefix neighbours on either side in
each run, and the run's densest node (that with the longest prefixes shared
with its neighbours), which ties a run together without its pairs.

Neighbours alone miss pairs in a crowd, and do not see over the ends of a run.
So where a region of over reach + 1 nodes holds several components after that,
its nodes are compared in full: by signatures in blocks, then those nodes that
have a likely partner in another component on their full sets, again in
blocks. Nodes of a region's largest component are not compared with each
other, and only links of components leave a block, never its pairs.

Candidates whose signatures agree in too few of 128 places (over four standard
deviations below the threshold) go; all other links are confirmed on the full
sets. First each node's best candidate is confirmed, then those candidates
that would join different components. Links within a component change nothing.
The forest is probabilistic: the README has its recall against brute force.

Texts travel in Arrow batches bounded in bytes, and sets are kept in a memory
bounded in bytes, so a worker's memory depends on the longest text only.

Defined results: without text or words the set is empty, n_shingles is 0 and
the document is its own component. A null doc_id links to nothing: its
component_id is null and it is kept. Rows with one doc_id are rows of their
own. Columns other than doc_id and text are ignored. An empty table gives no
rows. Equal sets are always linked, however many documents share them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestar.llm.common import arrow_batches, forget, ship, stored
from lodestar.llm.components import components

TREES, STEP, PLACES, DEPTH, LABEL = 16, 8, 128, 4, 28
REGION_LIMIT = 1000
REACH = 3
DEEPER = 2
SIG_BLOCK, SET_BLOCK = 1024, 256
SETS_KEPT = 16 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_rng = np.random.default_rng(20_240_607)
_TABLE = _rng.integers(0, 2**64, size=(64, 256), dtype=np.uint64)
_FAR = _rng.integers(0, 2**64, size=4096, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(0, 2**32, size=(PLACES, 1), dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, size=(PLACES, 1), dtype=np.uint32)
_MIX = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased, by random tables over place and byte."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    value = _TABLE[place & 63, raw[inside]]
    if lengths.max() > 64:
        value = value * np.where(place < 64, np.uint64(1), _FAR[(place >> 6) & 4095])
    return np.add.reduceat(value, starts)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(k, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = _scramble(total * _MIX[i] + words[i : len(words) - width + 1 + i])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima of linear permutations of the upper 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    return np.min([(_A * x[:, i : i + 8192] + _B).min(axis=1) for i in range(0, x.shape[1], 8192)], axis=0)


def _describe(text: str | None, k: int) -> tuple:
    found = shingle_set(text, k)
    if not len(found):
        return 0, None, None, None
    low = signature(found)
    first = [_MIX[STEP * 2 + t] for t in range(TREES)]
    regions = np.array(first, dtype=np.uint64)
    for i in range(DEPTH):
        regions = _scramble(regions * _MIX[48 + i] + low[[(STEP * t + i) % PLACES for t in range(TREES)]].astype(np.uint64))
    small = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), regions.view(np.int64).tolist(), small.tobytes()


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (128-bit digest of the set), regions and signature of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_describe(t, k) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [r[0] for r in rows], "node": [r[1] for r in rows], "regions": [r[2] for r in rows], "sig": [r[3] for r in rows]}).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, node binary, regions array<long>, sig binary")


def _label(t: str, places: int):
    """The first places of the label in tree t after those of the region."""
    return F.substring(F.concat("sig", "sig"), F.expr(f"{STEP} * {t} + {DEPTH} + 1"), F.lit(places))


def _common_hex(a: str, b: str):
    """How many hexadecimal digits two binary columns share from the start on; 0 where one is null."""
    return F.coalesce(F.length(F.regexp_extract(F.concat_ws("|", F.hex(a), F.hex(b)), r"^([0-9A-F]*)[0-9A-F]*\|\1", 1)), F.lit(0))


def runs(nodes: DataFrame, limit: int = REGION_LIMIT) -> tuple[DataFrame, list[DataFrame]]:
    """(run, label, node): every node in each region that it shares, in stretches of the order of up to about 2 * limit rows; and the stored tables that this reads."""
    rows = nodes.select("node", "sig", F.posexplode("regions").alias("t", "region"))
    counts = rows.groupBy(F.col("region").alias("of_region")).agg(F.count(F.lit(1)).alias("members"))
    counts = stored(counts.where("members > 1"), "regions")
    crowded = counts.where(F.col("members") > limit).select("of_region")
    small = counts.where(F.col("members") <= limit).select("of_region")
    here, tables = F.col("region") == F.col("of_region"), [counts]
    out = [rows.select("region", _label("t", LABEL).alias("label"), "node").join(small, here, "left_semi").withColumnRenamed("region", "run")]
    open_runs = None
    if not crowded.isEmpty():
        deep = rows.select("region", "t", "node").join(crowded, here, "left_semi").join(nodes.select("node", "sig"), "node")
        open_runs = deep.select(F.col("region").alias("run"), _label("t", PLACES - DEPTH).alias("label"), "node")
    while open_runs is not None:
        facts = open_runs.groupBy(F.col("run").alias("of_run")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        facts = stored(facts.select("of_run", "n", F.floor(_common_hex("low", "high") / 2).cast("int").alias("depth")), "run-facts")  # least and greatest label share what all share
        known = open_runs.join(facts, F.col("run") == F.col("of_run"))
        place = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("double") / 2**32
        equal = known.where(F.col("depth") == PLACES - DEPTH)  # all values agree: cut by the order of digests
        out.append(equal.select(F.xxhash64("run", F.floor(place * F.ceil(F.col("n") / limit))).alias("run"), "label", "node"))
        known = known.where(F.col("depth") < PLACES - DEPTH).select("run", "label", "node", F.substring("label", F.col("depth") + 1, F.lit(DEEPER)).alias("part"))
        parts = known.groupBy(F.col("run").alias("of_run"), F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))  # at most 65,536 of a run, at least two
        before = Window.partitionBy("of_run").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
        big = F.col("n") > limit
        filled = F.coalesce(F.sum(F.when(big, 0).otherwise(F.col("n"))).over(before), F.lit(0))
        passed = F.coalesce(F.sum(F.when(big, 1).otherwise(0)).over(before), F.lit(0))
        cut = F.when(big, F.xxhash64("of_run", "of_part")).otherwise(F.xxhash64("of_run", passed, F.floor(filled / limit)))
        parts = parts.select("of_run", "of_part", cut.alias("cut"), big.alias("still"))
        cuts = stored(known.join(parts, (F.col("run") == F.col("of_run")) & (F.col("part") == F.col("of_part"))).select(F.col("cut").alias("run"), "label", "node", "still"), "runs")
        tables += [facts, cuts]
        out.append(cuts.where("not still").drop("still"))
        left = cuts.where("still").drop("still")
        open_runs = None if left.isEmpty() else left
    laid = out[0]
    for more in out[1:]:
        laid = laid.unionAll(more)
    return laid, tables


def candidates(nodes: DataFrame, region_limit: int = REGION_LIMIT, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of nodes that are neighbours in a run, or member and densest node of one; and the stored table that they come from."""
    along = Window.partitionBy("run").orderBy("label", "node")
    near = [f"n{i}" for i in range(1, reach + 1)]
    laid, tables = runs(nodes, region_limit)
    laid = laid.withColumns({"before": F.lag("label").over(along)} | {c: F.lag("node", i).over(along) for i, c in enumerate(near, 1)})
    # members of one run share more with their neighbours the denser the place is
    laid = laid.withColumn("shared", F.when(F.col("before").isNull(), 0).otherwise(_common_hex("label", "before")))
    laid = stored(laid.select("run", "node", "shared", *near), "orders")
    forget(*tables)
    hubs = laid.groupBy(F.col("run").alias("of_run")).agg(F.max(F.struct("shared", "node"))["node"].alias("hub"))
    to_hub = laid.join(hubs, F.col("run") == F.col("of_run")).select("node", F.col("hub").alias("other"))
    to_near = laid.select("node", F.explode(F.array(*near)).alias("other"))
    pairs = to_hub.unionAll(to_near).where("other is not null and other <> node")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), laid


@F.pandas_udf(IntegerType())
def agreements(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places of two signatures that agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, PLACES) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


def _links(batches: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """The pairs of rows (a, b, text_a, text_b) whose sets are linked; sets seen lately are kept, up to SETS_KEPT bytes."""
    kept, held = {}, 0

    def of(node: bytes, text: str) -> np.ndarray:
        nonlocal held
        if (found := kept.get(node)) is None:
            found = shingle_set(text, k)
            if held > SETS_KEPT:
                kept.clear()
                held = 0
            kept[node], held = found, held + found.nbytes
        return found

    for rows in batches:
        good = []
        for a, b, one, two in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
            x, y = of(a, one), of(b, two)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield rows.loc[good, ["a", "b"]]


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    one = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInPandas(lambda rows: _links(rows, k, percent), "a binary, b binary")


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches sorted by key."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = held["key"].to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)]
        for start, end in zip(edges, edges[1:]):
            yield held.iloc[start:end]
        held = held.iloc[edges[-1] :]
    if held is not None and len(held):
        yield held


def _block_pairs(rows: DataFrame, group: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows once for each pair of blocks of their group, sorted by key; side is 0 or 1, or 2 where both blocks are one.

    sizes has of_group, top, n_top and n_rest: blocks of the root top meet blocks of other roots only.
    """
    rows = rows.join(sizes, F.col(group) == F.col("of_group")).withColumn("main", F.col("root") == F.col("top"))
    blocks = lambda n: F.ceil(F.col(n) / block)
    rows = rows.withColumns({"of_top": blocks("n_top"), "of_rest": blocks("n_rest")}).where("of_rest > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("of_top")).otherwise(F.col("of_rest")))
    with_rest = F.sequence(F.lit(0).cast("long"), F.col("of_rest") - 1)
    with_top = F.transform(F.sequence(F.lit(1).cast("long"), F.col("of_top")), lambda i: -i)  # blocks of top count down from -1
    rows = rows.withColumn("own", F.when(F.col("main"), -1 - own).otherwise(own))
    rows = rows.withColumn("with", F.explode(F.when(F.col("main"), with_rest).otherwise(F.concat(with_rest, with_top))))
    side = F.when(F.col("own") == F.col("with"), 2).otherwise(F.when(F.col("own") < F.col("with"), 0).otherwise(1))
    rows = rows.withColumns({"side": side, "key": F.xxhash64(group, F.least("own", "with"), F.greatest("own", "with"))})
    return rows.drop(group, "of_group", "top", "n_top", "n_rest", "main", "of_top", "of_rest", "own", "with").repartition("key").sortWithinPartitions("key")


def _sizes(rows: DataFrame, group: str) -> DataFrame:
    """of_group, top (the root of most rows), n_top and n_rest of each group that holds several roots."""
    each = rows.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy(F.col(group).alias("of_group")).agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("members"))
    found = found.select("of_group", F.col("most.root").alias("top"), F.col("most.n").alias("n_top"), (F.col("members") - F.col("most.n")).alias("n_rest"))
    return found.where("n_rest > 0")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places that agree, of each row of x with each row of y."""
    if len(x) * len(y) < 4096:
        return (x[:, None, :] == y[None, :, :]).sum(axis=2)
    out = np.zeros((len(x), len(y)), dtype=np.uint8)
    for i in range(PLACES):
        out += x[:, i][:, None] == y[:, i][None, :]
    return out


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y."""
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    place = lambda sets: [np.searchsorted(both, s[np.isin(s, both)]) for s in sets]
    px, py, out, width = place(x), place(y), np.zeros((len(x), len(y)), dtype=np.float64), 4096
    for low in range(0, len(both), width):
        dense = []
        for places in (px, py):
            m = np.zeros((len(places), width), dtype=np.float32)
            for i, p in enumerate(places):
                m[i, p[np.searchsorted(p, low) : np.searchsorted(p, low + width)] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _likely_others(batches: Iterator[pd.DataFrame], floor: int, percent: int) -> Iterator[pd.DataFrame]:
    """(node, root, other): nodes with a likely partner in another component, and a root they are tied to."""
    for rows in _grouped(batches):
        root, roots = pd.factorize(rows["root"])
        if len(roots) < 2:
            continue
        side, n, node = rows["side"].to_numpy(), rows["n"].to_numpy(), rows["node"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(-1, PLACES)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            continue
        near = _agree(sig[left], sig[right]) >= floor
        near &= root[left][:, None] != root[right][None, :]
        a, b = n[left][:, None], n[right][None, :]
        near &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        tied = np.zeros(len(rows), dtype=bool)
        tied[left], tied[right] = tied[left] | near.any(axis=1), tied[right] | near.any(axis=0)
        if not tied.any():
            continue
        label, last = np.arange(len(rows), dtype=np.int32), None
        while last is None or (label != last).any():  # least label of those tied together
            last, label = label, label.copy()
            label[right] = np.minimum(label[right], np.where(near, label[left][:, None], len(rows)).min(axis=0))
            label[left] = np.minimum(label[left], np.where(near, label[right][None, :], len(rows)).min(axis=1))
        yield pd.DataFrame({"node": node[tied], "root": roots[root[tied]], "other": roots[root[label[tied]]]})


def _true_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """(a, b): roots of components that a pair of full sets links, each once a block pair."""
    for rows in _grouped(batches):
        root, roots = pd.factorize(rows["root"])
        side = rows["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if len(roots) < 2 or not len(left) or not len(right):
            continue
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        both = _common([sets[i] for i in left], [sets[i] for i in right])
        union = size[left][:, None] + size[right][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (root[left][:, None] != root[right][None, :]))
        if len(i):
            pairs = np.unique(np.stack([root[left[i]], root[right[j]]]), axis=1)
            yield pd.DataFrame({"a": roots[pairs[0]], "b": roots[pairs[1]]})


def with_sets(docs: DataFrame, members: DataFrame, k: int, text: bool) -> DataFrame:
    """members (doc, node and more) with the text, or the set, of their document; several documents may have the id."""
    columns = [f for f in members.schema.fields if f.name != "doc"]
    names = [f.name for f in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, k).tobytes() for t in batch["text"]]
            same = [hashlib.blake2b(s, digest_size=16).digest() == n for s, n in zip(found, batch["node"], strict=True)]
            yield (batch if text else batch.assign(shingles=found))[np.array(same, dtype=bool)][[*names, "text" if text else "shingles"]]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members, "doc").select(*names, "text")
    of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    return texts.mapInPandas(run, f"{of}, text string" if text else f"{of}, shingles binary").dropDuplicates(["node"])


def crowd_links(docs: DataFrame, nodes: DataFrame, k: int, percent: int, floor: int, reach: int, sig_block: int = SIG_BLOCK, set_block: int = SET_BLOCK) -> DataFrame | None:
    """Links (a, b) of roots that the neighbours of crowded regions missed; nodes have node, root, doc, n, sig and regions."""
    rows = nodes.select("node", "root", F.explode("regions").alias("region"))
    crowded = rows.groupBy(F.col("region").alias("of_region")).agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    crowded = crowded.where((F.col("members") > reach + 1) & (F.col("low") != F.col("high"))).select("of_region")
    rows = stored(rows.join(crowded, F.col("region") == F.col("of_region"), "left_semi"), "crowd-rows")
    sizes = stored(_sizes(rows, "region"), "crowd-sizes")
    rows = rows.join(nodes.select("node", "n", "sig"), "node")
    likely = _block_pairs(rows, "region", sizes, sig_block).mapInPandas(lambda b: _likely_others(b, floor, percent), "node binary, root binary, other binary")
    likely = stored(likely.distinct(), "crowd-likely", arrow_batches)
    if likely.isEmpty():
        return None
    # a node may be tied to its own root only, by a block in which that has the least label
    crowds = components(likely.select(F.col("root").alias("a"), F.col("other").alias("b")))
    members = likely.select("node", "root").distinct().join(crowds.select(F.col("node").alias("root"), F.col("root").alias("crowd")), "root")
    members = stored(members.join(nodes.select("node", "doc"), "node"), "crowd-members")
    full = stored(with_sets(docs, members, k, False), "crowd-sets", arrow_batches)
    pairs = _block_pairs(full, "crowd", stored(_sizes(full, "crowd"), "crowd-set-sizes"), set_block)
    return stored(pairs.mapInPandas(lambda b: _true_links(b, percent), "a binary, b binary").distinct(), "crowd-links", arrow_batches)


def _lifted(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """rooted with the roots that links (a, b) of roots lead to."""
    lifted = components(links).select(F.col("node").alias("of_root"), F.col("root").alias("top"))
    return stored(rooted.join(lifted, F.col("root") == F.col("of_root"), "left").withColumn("root", F.coalesce("top", "root")).drop("of_root", "top"), "rooted")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, region_limit: int = REGION_LIMIT, reach: int = REACH, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least linked doc_id) and kept of each document; keyed: with text_hash, xxhash64(text), too."""
    ship(docs.sparkSession)
    described = stored(describe(docs, k), "described", arrow_batches)
    nodes = stored(described.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("regions").alias("regions"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "nodes")

    floor = int(PLACES * percent / 100 - 4.2 * (PLACES * percent * (100 - percent)) ** 0.5 / 100)
    sigs = nodes.select("node", "sig")
    likely, orders = candidates(nodes, region_limit, reach)
    likely = likely.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    likely = stored(likely.select("a", "b", agreements("sig_a", "sig_b").alias("agree")).where(F.col("agree") >= floor), "likely")
    forget(orders)

    active = likely.select(F.col("a").alias("node")).unionAll(likely.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc"), "node")
    texts = stored(with_sets(docs, active, k, True), "active-texts", arrow_batches)

    either = likely.select(F.col("a").alias("node"), "a", "b", "agree").unionAll(likely.select(F.col("b").alias("node"), "a", "b", "agree"))
    best = either.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    links_best = stored(confirmed(best, texts, k, percent), "links-best", arrow_batches)
    joined = components(links_best).withColumnRenamed("node", "of_node")
    rooted = stored(nodes.select("node", "doc").join(joined, F.col("node") == F.col("of_node"), "left").select("node", "doc", F.coalesce("root", "node").alias("root")), "rooted")
    root = lambda side: rooted.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    rest = likely.join(best, ["a", "b"], "left_anti").join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b").select("a", "b")
    links_rest = stored(confirmed(rest, texts, k, percent), "links-rest", arrow_batches)
    forget(texts, likely, links_best)
    links = links_rest.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    rooted = _lifted(rooted, links)
    more = crowd_links(docs, nodes.drop("doc").join(rooted, "node"), k, percent, floor, reach)
    if more is not None:
        rooted = _lifted(rooted, more)

    of_root = rooted.select("node", "root", "doc")
    least = of_root.groupBy("root").agg(F.min("doc").alias("least"))
    firsts = of_root.select(F.col("node").alias("of_node"), "root").join(least, "root").select("of_node", "least")
    key = ["doc_id", "text_hash"] if keyed else ["doc_id"]
    rows = described.select(*key, "n_shingles", "node").join(firsts, F.col("node") == F.col("of_node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "doc_id"))
    return rows.select(*key, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
