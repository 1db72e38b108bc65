"""Operators on pages and vectors, and the pipeline, against brute force on small tables."""

import base64
import hashlib
import io
import math
import zlib

import numpy as np
import pytest

from lodestar.llm import decontam, linededup, mixing, neardup, quality, queries, topk, urlfilter, warc

URLS = [
    (1, None, ("", "", None)), (2, "abc", ("", "", None)), (3, "http://EXAMPLE.org", ("example.org", "", None)), (4, "http://a.example.org/es/x?y#z", ("a.example.org", "/es/x", "example.org/es/")),
    (5, "x://Example.ORG/en/12#/es/", ("example.org", "/en/12", "example.org/en/1")), (6, "http://example.org/en/2", ("example.org", "/en/2", "org/")), (7, "http://anexample.org/es/", ("anexample.org", "/es/", "org/")),
    (8, "https://b.com/de/1", ("b.com", "/de/1", "com/de/")), (9, "https://com/fr/", ("com", "/fr/", "com/fr/")), (10, "https://É.COM/x", ("É.com", "/x", None)), (11, "", ("", "", None)), (11, "", ("", "", None)), (12, "a://b://c/d", ("b:", "//c/d", None)),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u, _ in URLS], "page_id long, url string, html string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule) for r in urlfilter.judge(pages).collect())
    assert sorted(map(str, got)) == sorted(str((i, *want)) for i, _, want in URLS)
    verdicts = {r.page_id: r.verdict for r in urlfilter.judge(pages).collect()}
    assert [verdicts[i] for i in (4, 5, 6, 8, 9)] == ["block", "block", "allow", "block", "allow"] and set(verdicts.values()) <= {"allow", "block"}
    assert urlfilter.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages.where("page_id in (1, 2)")).collect()} == {"allow"}


def test_url_model_learns():
    hosts, paths = ["a.net"] * 40, [f"/{'es' if i % 2 else 'fr'}/{i}" for i in range(40)]
    model = urlfilter.fit(hosts, paths, np.array([i % 2 for i in range(40)], dtype=float))
    assert (urlfilter._logits(["a.net", "a.net"], ["/es/999", "/fr/999"], model) > 0).tolist() == [True, False]


PAGES = [(1, "u", "same"), (2, None, "same"), (3, "x\r\ny", "a é\r\n\r\nWARC/1.0"), (4, "z", None), (5, "z", ""), (6, "z", "unique"), (6, "z", "unique"), (None, "z", "same"), (7, "z", "x" * 300_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, record_type string, digest int")
    got = warc.round_trip(pages, f"file://{tmp_path}/w", file_bytes=200).collect()
    last = {}
    for i, _, html in PAGES:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in PAGES:
        payload, to = (html or "").encode(), last[html or ""]
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == to else "revisit", None if i == to else to))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert len(list(tmp_path.glob("w/*.warc.gz"))) > 1
    assert warc.round_trip(pages.where("false")).count() == 0
    small = warc.round_trip(pages, f"file://{tmp_path}/v", min_bytes=5).where("page_id in (1, 2)").collect()
    assert {r.record_type for r in small} == {"response"}


def test_warc_files_hold_one_gzip_member_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"payload {i}" * i) for i in range(1, 30)], "page_id long, url string, html string")
    written = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w").collect()
    for r in written:
        with open(r.path, "rb") as f:
            rest = f.read()
        assert len(rest) == r.bytes
        members = 0
        while rest:
            member = zlib.decompressobj(31)
            assert member.decompress(rest).startswith(b"WARC/1.1\r\n") and member.eof
            members, rest = members + 1, member.unused_data
        assert members == r.records
    assert sum(r.records for r in written) == 29
    (tmp_path / "own.warc.gz").write_bytes(b"".join(warc.page_record(i, "u", b"x" * i, None, False) for i in range(5)))
    own = spark.createDataFrame([(f"{tmp_path}/own.warc.gz",)], "path string")
    assert {(r.page_id, r.payload_bytes) for r in warc.read_archives(own, f"file://{tmp_path}").collect()} == {(i, i) for i in range(5)}


def test_warc_reader_rejects_damage():
    record = warc.page_record(1, "u", b"payload" * 100, None, False)
    assert [b for _, b in warc.read_records(io.BytesIO(record * 3))] == [b"payload" * 100] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(record[:-20])))
    plain = zlib.decompress(record, 31)
    for broken in (plain.replace(b"payload", b"pAyload", 1), plain.replace(b"Content-Length: 700", b"Content-Length: 600")):
        pack = zlib.compressobj(wbits=31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(pack.compress(broken) + pack.flush())))


def brute_top(rows, k):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in kept:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "rings": 2, "block_rows": 5}])
def test_top_k(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    rows += [(100 + i, [0.5] * 6) for i in range(30)] + [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf")]), (280, []), (300, [2.0]), (None, [1.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, cell int")
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, **options).collect()}
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(rounded, 20)


def test_top_k_few_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(vectors, vectors).collect()} == {(0, 1, 20, 4096), (20, 1, 0, 4096)}
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_pipeline_equals_its_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    out = {tuple(r) for r in pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    docs = docs.where(docs.doc_id.isin(*kept))
    lines = linededup.dedup_lines(docs).collect()
    rows = [(r.doc_id, r.text, r.source) for r in lines if r.n_removed == 0 or (r.text or "").strip()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    firsts = {r.doc_id for r in neardup.near_duplicates(docs, 5, 80).where("kept").collect()}
    docs = docs.where(docs.doc_id.isin(*firsts))
    clean = {r.doc_id for r in decontam.decontaminate(docs, bench).where("not contaminated").collect()}
    assert out == {tuple(r) for r in mixing.mix(docs.where(docs.doc_id.isin(*clean))).where("taken > 0").collect()}
    assert [name for name, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
