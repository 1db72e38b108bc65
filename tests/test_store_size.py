"""What a write of the store shuffles and sorts, and that it holds the same rows."""

import pytest

from lodestar.functions.embedding import HashEmbedder
from lodestar.operators import textsearch
from lodestar.plans import store as stores
from lodestar.plans.config import EngineConfig
from lodestar.plans.engine import Engine
from lodestar.plans.store import Store

ROW = "chunk_id string, doc_id string, text string, ord long"
MOVES = ("Window", "Sort", "RepartitionByExpression", "Repartition ")


def plans_of(monkeypatch) -> list[tuple[str, str]]:
    """(name of the table, optimized plan) of each table that a store writes."""
    seen, write = [], Store._write

    def noted(self, df, path, *codec):
        seen.append((path.rpartition("/")[2], df._jdf.queryExecution().optimizedPlan().toString()))
        write(self, df, path, *codec)

    monkeypatch.setattr(Store, "_write", noted)
    return seen


def many(spark, n=60):
    return spark.createDataFrame([(f"c{i}", f"d{i}", " ".join(f"t{(i * j) % 7}" for j in range(i % 12)) + " end", i) for i in range(n)], ROW)


def test_postings_come_in_sorted_runs(spark, monkeypatch):
    """Within a run terms and chunks ascend; runs are of several batches, and postings go out in small parts."""
    monkeypatch.setattr(textsearch, "TOKENS_AT_ONCE", 200)
    monkeypatch.setattr(textsearch, "ROWS_AT_ONCE", 7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = [(r.term, r.chunk_id, r.dl, r.tf, tuple(r.positions)) for r in textsearch.build(many(spark).coalesce(1), unique=True).postings.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    texts = {r.chunk_id: r.text.split() for r in many(spark).collect()}
    want = {(t, c, len(x), x.count(t), tuple(i for i, w in enumerate(x) if w == t)) for c, x in texts.items() for t in x}
    assert set(got) == want and len(got) == len(want)
    breaks = sum(a[:2] > b[:2] for a, b in zip(got, got[1:], strict=False))
    total = sum(len(x) for x in texts.values()) + len(texts)
    assert 1 <= breaks <= 2 * total // 200


@pytest.mark.parametrize("name", ["chunks", "postings"])
def test_an_ingest_moves_no_text(spark, tmp_path, monkeypatch, name):
    """Chunks and postings of files are written where they are made; both were dealt out and sorted before."""
    seen = plans_of(monkeypatch)
    engine = Engine(spark, EngineConfig(store_root=f"file://{tmp_path}/store", dim=8), HashEmbedder(dim=8))
    files = spark.createDataFrame([(f"in/{i}.txt", bytearray(f"text number {i}".encode()), 14) for i in range(9)], "path string, content binary, size long").selectExpr("*", "timestamp'2024-01-02' AS modified")
    engine.ingest_files(files, at="2024-01-01T00:00:00Z")
    plans = [plan for table, plan in seen if table.startswith(name)]
    assert plans and not any(word in plan for plan in plans for word in MOVES)
    assert engine.chunks.count() == 9 and engine.search_text("number", 20).count() == 9 and engine.postings.count() == 27
    assert not list((tmp_path / "store").glob("staging/*"))


def test_of_repeated_ids_the_last_row_stays(spark, tmp_path):
    """Also of ids that are null; rows of other ids are left alone."""
    rows = [("a", "d", "one", 1), ("a", "d", "two", 2), ("a", "d", "three", None), ("b", "d", "x", 1), ("b", "d", "y", 1), ("c", "d", "z", 1), (None, "d", "u", 1), (None, "d", "v", 2)]
    for mode in ("replace", "upsert"):
        store = Store(spark, f"file://{tmp_path}/{mode}")
        store.upsert(spark.createDataFrame(rows, ROW), mode=mode)
        assert sorted((str(r.chunk_id), r.text) for r in store.chunks.collect()) == [("None", "v"), ("a", "two"), ("b", "y"), ("c", "z")]
        assert sorted(r.term for r in store.text_index().postings.collect()) == ["two", "v", "y", "z"]
        assert not list((tmp_path / mode).glob("staging/*"))


@pytest.mark.parametrize("most", [0, 16 << 20])
def test_tombstones_sort_no_rows(spark, tmp_path, monkeypatch, most):
    """Few are broadcast, many are dealt by key, and neither way sorts rows, as was done before when they weren't small enough to be broadcast by themselves."""
    monkeypatch.setattr(stores, "BROADCAST_BYTES", most, raising=False)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        store = Store(spark, f"file://{tmp_path}/store")
        store.upsert(many(spark))
        store.upsert(many(spark).where("ord % 3 = 0").selectExpr("chunk_id", "doc_id", "'again' AS text", "ord + 100 AS ord"), mode="upsert")
        store.delete_ids(["c1", "c3"])
        store.upsert(spark.createDataFrame([("c3", "d3", "back", 3)], ROW), mode="upsert")
        postings = store.table("postings")
        plan = postings._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and ("ShuffledHashJoin" in plan) == (most == 0)
        got = {r.chunk_id: (r.text, r.ord) for r in store.chunks.collect()}
        texts = {r.chunk_id: (r.text, r.ord) for r in many(spark).collect()}
        want = {c: ("again", o) if o % 3 == 0 else (t, o) for c, (t, o) in texts.items() if c != "c1"} | {"c3": ("back", 3)}
        assert got == want
        assert sorted((r.term, r.chunk_id) for r in postings.collect()) == sorted({(w, c) for c, (t, _) in want.items() for w in t.split()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_size_of_tombstones_bounds_their_number(spark, tmp_path):
    """Regular ids, which would be compressed to less than a byte each, take their own bytes: their size decides how they are joined."""
    store = Store(spark, f"file://{tmp_path}/store")
    store.upsert(spark.range(20_000).selectExpr("concat('k', lpad(id, 8, '0')) AS chunk_id", "'d' AS doc_id", "'a' AS text", "id AS ord"))
    store.delete([], allow_all=True)
    (path, _), = store.manifest()["gone"]["chunks"]
    assert store._bytes(path) >= 20_000 * 9 and store.chunks.isEmpty()


def test_compaction_sorts_postings_as_a_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.upsert(many(spark))
    store.upsert(spark.createDataFrame([("new", "new", "t1 a z", 0)], ROW))
    before = sorted(map(str, store.table("postings").collect()))
    store.compact()
    (path, _), = store.manifest()["tables"]["postings"]
    got = [(r.term, r.chunk_id) for r in spark.read.parquet(f"file://{tmp_path}/store/{path}").coalesce(1).collect()]
    assert sorted(map(str, store.table("postings").collect())) == before and {g[0] for g in got} >= {"a", "end", "z"}
    for part in (tmp_path / "store" / path).glob("*.parquet"):
        keys = [(r.term, r.chunk_id) for r in spark.read.parquet(f"file://{part}").collect()]
        assert keys == sorted(keys)
