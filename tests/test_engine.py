import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions.embedding import HashEmbedder, InputTooLong, length_batches, pool
from lodestar.operators import filters as flt
from lodestar.operators import fusion, textsearch, vector
from lodestar.plans import config as cfg
from lodestar.plans.engine import Engine
from lodestar.plans.query_parser import parse
from lodestar.plans.store import IndexNotReady, StaleWrite, Store
from lodestar.plans.templates import PromptTemplate, PromptTemplates, expand, parse_token
from lodestar.sources import files as sources
from lodestar.streaming import folder


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, cfg.EngineConfig(store_root=f"file://{tmp_path}/store", dim=8))


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, extracted_at string, ord long, source_uri string, meta map<string,string>")


ROWS = [
    ("c1", "d1", "copper kettle", "2024-01-02T00:00:00Z", 0, "file:///a/x.txt", {"n": "5"}),
    ("c2", "d1", "walnut table", "2024-06-01T00:00:00Z", 1, "file:///a/x.txt", {"n": "abc"}),
    ("c3", "d1", "copper wire", "2025-01-10T00:00:00Z", 2, "file:///b/y.txt", {"n": "11"}),
    ("c4", "d2", "  ", "2025-01-10T00:00:00Z", 0, "file:///b/z.txt", {}),
]


def test_search_with_filters(spark, engine):
    engine.ingest_chunks(chunks(spark, ROWS))
    assert engine.repo_counts() == {"chunks": 3, "files": 0, "vectors": 3, "doclen": 3}
    early = flt.RangeIsoDate(key="extracted_at", high="2024-12-31")
    assert [r.chunk_id for r in engine.search_text("copper", clauses=[early]).collect()] == ["c1"]
    assert [r.chunk_id for r in engine.search_text("copper").collect()] == ["c1", "c3"]
    assert engine.search_text("  ").count() == 0 and engine.search_text("copper", top_k=0).count() == 0
    assert [r.chunk_id for r in engine.search_text('"copper wire"').collect()] == ["c3"]
    assert {r.chunk_id for r in engine.search_text("copper -wire").collect()} == {"c1"}
    assert engine.search_text("copper", mode="and").count() == 2
    assert {r.chunk_id for r in engine.search_hybrid("copper", clauses=[early]).collect()} == {"c1", "c2"}
    assert engine.search_multi("copper", mode="text").count() == 2
    assert engine.match_count([flt.DocIdEq(value="d1")]) == 3 and engine.postings.where("term = 'copper'").count() == 2


SENTENCES = [("s1", "red copper pipe"), ("s2", "copper pipe and steel rod"), ("s3", "steel pipe with copper"), ("s4", "pipe organ"), ("s5", "steel rod, red"), ("s6", "copper pipe, copper pipe")]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ('red "copper pipe"', {"s1", "s2", "s5", "s6"}), ('"copper pipe" "steel rod"', {"s1", "s2", "s5", "s6"}), ('+red "copper pipe"', {"s1", "s5"}), ('pipe -"copper pipe"', {"s3", "s4"}),
        ('+"copper pipe" +"steel rod"', {"s2"}), ('"copper pipe" AND steel', {"s2"}), ("-pipe", set()), ('pipe NOT "pipe organ" NOT steel', {"s1", "s6"}), ("copper-pipe", {"s1", "s2", "s6"}), ("+copper -red -steel", {"s6"}),
    ],
)
def test_search_syntax(spark, query, ids):
    index = textsearch.build(spark.createDataFrame(SENTENCES, "chunk_id string, text string"))
    hits = textsearch.parsed_scores(index, query)
    assert ({r.chunk_id for r in hits.collect()} if hits is not None else set()) == ids
    assert {r.chunk_id for r in textsearch.triple(index, query).where("tv is not null").collect()} == ids


def test_phrases_score_by_their_places(spark):
    index = textsearch.build(spark.createDataFrame(SENTENCES, "chunk_id string, text string"))
    score = {r.chunk_id: r.raw_score for r in textsearch.parsed_scores(index, '"copper pipe"').collect()}
    assert score["s6"] > score["s1"] > score["s2"]  # two places; then the shorter text
    both = {r.chunk_id: r.raw_score for r in textsearch.parsed_scores(index, 'red "copper pipe"').collect()}
    assert both["s1"] > score["s1"] and both["s2"] == pytest.approx(score["s2"])
    stored = textsearch.TextIndex(index.postings, index.doclen)
    assert {r.chunk_id: r.raw_score for r in textsearch.parsed_scores(stored, '"copper pipe"').collect()} == pytest.approx(score)


def test_of_two_writers_one_is_told(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.upsert(chunks(spark, ROWS))
    base = store.manifest()
    pinned = store.pinned()
    store.delete_ids(["c1"])
    with pytest.raises(StaleWrite):
        store.commit({"chunks": chunks(spark, ROWS)}, base)
    assert {r.chunk_id for r in store.chunks.collect()} == {"c2", "c3"} and store.manifest()["version"] == 2
    assert {r.chunk_id for r in pinned.chunks.collect()} == {"c1", "c2", "c3"}  # still the version it was made from
    assert {r.chunk_id for r in store.text_index().postings.collect()} == {"c2", "c3"}
    assert not store.rebuild_if_empty() and store.vacuum() >= 1 and store.manifest()["version"] == 3  # compacted
    assert {r.chunk_id for r in store.chunks.collect()} == {"c2", "c3"}
    assert not list((tmp_path / "store").glob("staging/*")) and not list((tmp_path / "store").glob("manifests/*.tmp"))


def test_writes_add_their_own_rows_only(spark, tmp_path, monkeypatch):
    """Segments of a write hold its rows, a delete adds keys; compaction keeps what is live."""
    store, root = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/store"
    many = [(f"k{i}", f"d{i % 50}", f"text number {i}", "2024", i, "u", {}) for i in range(200)]
    files = spark.createDataFrame([(f"d{i}", "u") for i in range(50)], "doc_id string, source_uri string")
    store.upsert(chunks(spark, many), files)
    one = [("new", "d7", "another text", "2024", 0, "u", {}), ("k9", "d9", "text put again", "2024", 0, "u", {})]
    store.upsert(chunks(spark, one[:1]), mode="replace")
    store.upsert(chunks(spark, one[1:]), mode="upsert")
    written = lambda name: [spark.read.parquet(f"{root}/{path}").count() for path, _ in store.manifest()["tables"][name]]
    assert written("chunks") == [200, 1, 1] and written("doclen") == [200, 1, 1] and sum(written("postings")[1:]) == 5
    want = {c: t for c, d, t, *_ in many if d != "d7"} | {"new": "another text", "k9": "text put again"}
    assert {r.chunk_id: r.text for r in store.chunks.collect()} == want
    assert {r.ord for r in store.chunks.where("chunk_id = 'k9'").collect()} == {9}
    store.delete([flt.DocIdEq(value="d7")])
    assert store.delete_ids(["k9", "none"])["db_deleted"] == 1 and written("chunks") == [200, 1, 1]
    live = set(want) - {"new", "k9"}
    assert {r.chunk_id for r in store.chunks.collect()} == live == {r.chunk_id for r in store.text_index().doclen.collect()}
    assert {r.doc_id for r in store.files.collect()} == {f"d{i}" for i in range(50)} - {"d7"}
    before = store.counts()
    store.compact()
    assert store.counts() == before and written("chunks") == [len(live)] and not any(store.manifest()["gone"].values())
    assert store.vacuum() >= 4 and store.counts() == before
    store.upsert(chunks(spark, one))  # ids that were deleted come back
    assert {r.chunk_id for r in store.chunks.collect()} == {i for i in live if want[i] and int(i[1:]) % 50 not in (7, 9)} | {"new", "k9"}
    monkeypatch.setattr("lodestar.plans.store.MAX_SEGMENTS", 2)
    store.upsert(chunks(spark, one[:1]), mode="upsert")
    assert len(store.manifest()["tables"]["chunks"]) == 1


def test_vectors_are_those_of_the_chunks_that_stay(spark, engine):
    twice = chunks(spark, [("c1", "d1", "old text", "2024", 0, "u", {}), ("c1", "d1", "new text", "2024", 1, "u", {})])
    engine.ingest_chunks(twice)
    assert [r.text for r in engine.chunks.collect()] == ["new text"]
    assert [list(r.vec) for r in engine.vectors.collect()] == [pytest.approx(engine.embedder.embed(["new text"])[0])]


def test_csv_headers_of_every_file(spark, tmp_path):
    for i, text in enumerate(("head,x\n first ,1\n\"two, \"\"lines\"\"\nof one\",2\n", "head,x\nthird,3\n,4\n")):
        (tmp_path / f"{i}.csv").write_text(text)
    rows = [r.text for r in sources.read_one_column_csv(spark, f"file://{tmp_path}").collect()]
    assert sorted(rows) == ["first", "third", 'two, "lines"\nof one']
    assert sources.read_one_column_csv(spark, f"file://{tmp_path}", header=False, drop_empty=False).count() == 6


def test_upsert_delete_and_reports(spark, engine):
    with pytest.raises(IndexNotReady):
        engine.search_text("x")
    engine.ingest_chunks(chunks(spark, ROWS))
    engine.ingest_chunks(chunks(spark, [("c3", "d1", "copper spark", "2025-01-10", 9, "u", {})]), mode="upsert")
    assert {(r.chunk_id, r.text, r.ord) for r in engine.chunks.collect()} == {("c1", "copper kettle", 0), ("c2", "walnut table", 1), ("c3", "copper spark", 2)}
    assert engine.neighbor_chunks("c2") == ("c1", "c3")
    assert engine.neighbor_chunks("none") == (None, None)
    assert [r.chunk_id for r in engine.get_chunks(["c3", "missing", "c1", "c3"]).collect()] == ["c3", "c1"]
    with pytest.raises(ValueError):
        engine.delete_by_filter([])
    report = engine.delete_by_filter([flt.DocIdEq(value="d1")], batch=2)
    assert (report["total_ids"], report["db_deleted"], report["batches"]) == (3, 3, 2)
    assert engine.repo_counts()["chunks"] == 0 and engine.repo_counts()["vectors"] == 0
    assert engine.store.vacuum() > 0
    with pytest.raises(ValueError):
        engine.store.reset()
    engine.store.reset("RESET")
    assert engine.status()["version"] == 0


@pytest.mark.parametrize(
    ("clause", "ids"),
    [
        (flt.RangeNumeric(key="n", low=5), {"c1", "c3"}), (flt.RangeNumeric(key="n", low=5, low_open=True), {"c3"}), (flt.MetaEq(key="n", value="abc"), {"c2"}), (flt.MetaIn(key="n", values=()), set()),
        (flt.SourceUriPrefix(prefix="file:///b"), {"c3", "c4"}), (flt.DocIdIn(values=("d2",)), {"c4"}), (flt.MetaEq(key="none", value="x"), set()), (flt.RangeIsoDate(key="extracted_at", low="2024-06-01T00:00:00Z", as_timestamp=True), {"c2", "c3", "c4"}),
    ],
)
def test_filters(spark, clause, ids):
    assert {r.chunk_id for r in flt.keep(chunks(spark, ROWS), [clause]).collect()} == ids


def test_files_folder_and_stream(spark, engine, tmp_path):
    drop = tmp_path / "drop"
    (drop / "sub").mkdir(parents=True)
    (drop / "a.txt").write_text("first paragraph\r\nx\r\n\r\n\r\n second")
    (drop / "sub" / "b.md").write_bytes("naïve café".encode("cp1252"))
    (drop / "c.bin").write_bytes(b"\0\1")
    rejects = engine.ingest_files(f"file://{drop}", at="2024-01-01T00:00:00Z").collect()
    assert [r.path.rpartition("/")[2] for r in rejects] == ["c.bin"]
    assert engine.list_files().count() == 2
    assert {r.text for r in engine.chunks.where(F.col("source_uri").endswith("a.txt")).collect()} == {"first paragraph\nxsecond"}
    assert [r.path.rpartition("/")[2] for r in engine.unregistered(f"file://{drop}").collect()] == ["c.bin"]
    with pytest.raises(ValueError):
        engine.ingest_files(f"file://{drop}", doc_id="one")
    first = engine.repo_counts()
    query = folder.ingest_folder(engine, f"file://{drop}", f"file://{tmp_path}/checkpoint", "*.txt")
    query.awaitTermination(120)
    assert engine.repo_counts() == first
    chunk = engine.ingest_text(" new text ")
    assert engine.ingest_text("new text") == chunk
    with pytest.raises(ValueError):
        engine.ingest_text("  ")
    hits = engine.search_text("paragraph")
    assert "first paragraph" in engine.render_prompt(hits, "paragraph", 10)


def test_parse():
    q = parse('alpha +beta -gamma "two words" x AND y NOT z')
    assert (q.should, q.must, q.must_not, q.phrases) == (["alpha"], ["beta", "x", "y"], ["gamma", "z"], ["two words"])
    assert parse('"open').empty and parse(None).empty


def test_templates(spark):
    show = lambda t, **v: spark.range(1).select(expand(t, {k: F.lit(x) for k, x in v.items()})).first()[0]
    assert show("<<Rank>>/<<Nope>>/<<open", Rank=1) == "1//<<open"
    assert show("<<T:snippet(3)>>|<<T:escape_json>>", T='a"bc') == 'a"b…|a\\"bc'
    assert parse_token("Text:snippet(20)") == ("Text", "snippet", "20") and parse_token("Text:escape_json") == ("Text", "escape_json", None)
    both = PromptTemplates([PromptTemplate("a")])
    assert both.merge(PromptTemplates([PromptTemplate("a", items=2), PromptTemplate("b")])) == (1, 1)
    both.rename("b", "c")
    both.remove("a")
    assert list(both.by_name) == ["c"]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    config = cfg.EngineConfig(dim=5)
    cfg.save(config, str(path))
    config.prompts.put(PromptTemplate("mine"))
    config.dim = 9
    cfg.save(config, str(path))
    assert cfg.load(str(path)).dim == 5 and "mine" in cfg.load(str(path)).prompts.by_name
    cfg.save(config, str(path), "overwrite")
    assert cfg.load(str(path)).dim == 9
    path.write_text(json.dumps({"dim": 7, "min_chars": 10, "short_merge_min_chars": 3}))
    flat = cfg.load(str(path))
    assert (flat.dim, flat.chunk.min_chars, flat.chunk.short_merge_min_chars) == (7, 10, 100)
    assert cfg.suggested_name(" a/b  c? ") == "lodestar_config_a-b-c.json"


def test_embedders(spark):
    e = HashEmbedder(dim=4)
    a, b = e.embed(["x", "y"])
    assert a == e.embed(["x"])[0] != b and all(-1 <= v <= 1 for v in a + b) and e.embed([]) == []
    with pytest.raises(InputTooLong):
        HashEmbedder(max_chars=2).embed(["long"])
    import numpy as np

    hidden = np.array([[[1.0, 2], [3, 4], [9, 9]], [[1, 1], [1, 1], [1, 1]]])
    assert pool(hidden, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[2, 3], [0, 0]]
    row = spark.range(1).select(vector.mean_pool(F.expr("array(array(1d,2d),array(3d,4d),array(9d,9d))"), F.expr("array(1,1,0)")), vector.mean_pool(F.expr("array(array(1d,2d))"), F.expr("array(0)"))).first()
    assert list(row) == [[2.0, 3.0], [0.0, 0.0]]


def test_length_batches_halve_and_recover():
    plan = length_batches([5, 1, 300, 2], 100, first=4, least=1)
    assert next(plan) == [1, 3, 0]
    assert plan.send(False) == [1, 3]
    assert plan.send(True) == [0]
    assert plan.send(True) == [2]


def test_fusion_values(spark):
    text = spark.createDataFrame([("a", 0.8), ("b", 0.6)], "chunk_id string, score double")
    vec = spark.createDataFrame([("b", 0.9), ("c", 0.7)], "chunk_id string, score double")
    assert [(r.chunk_id, round(r.score, 6)) for r in fusion.hybrid(text, vec).collect()] == [("b", 0.75), ("a", 0.4), ("c", 0.35)]
    wide = spark.createDataFrame([("x", 0.9, 0.5)], "chunk_id string, tv_or double, vec double")
    assert round(fusion.fuse(wide, fusion.PRESET_NORMALISED).first().score, 6) == 0.58
    wide = spark.createDataFrame([("x", 0.9, 0.8, 0.5)], "chunk_id string, tv_and double, tv_or double, vec double")
    assert round(fusion.fuse(wide, fusion.PRESET_FIVE, normalise=False).first().score, 6) == 0.6
    half = spark.range(1).select(textsearch.logistic(F.lit(0.0)), F.round(textsearch.logistic(F.lit(0.3)), 6)).first()
    assert tuple(half) == (0.5, 0.574443)
