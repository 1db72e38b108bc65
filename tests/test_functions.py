import pytest
from pyspark.sql import functions as F

from lodestar.functions import analyze
from lodestar.functions import scalars as s
from lodestar.operators.segment import sentences
from lodestar.sources import files as src


@pytest.mark.parametrize(
    ("column", "value"),
    [
        (lambda: s.truncate(F.lit("abcd"), 3), "abc…"), (lambda: s.truncate(F.lit("abc"), 0), ""), (lambda: s.flatten_preview(F.lit("a\nb\tc")), "a b c"), (lambda: s.escape_json(F.lit('a"\\\n\x01')), 'a\\"\\\\\\n\\u0001'),
        (lambda: s.escape_tabs(F.lit("a\tb\r")), "a\\tb"), (lambda: s.humanize_bytes(F.lit(1536)), "1.5 KB"), (lambda: s.humanize_bytes(F.lit(5)), "5 B"), (lambda: s.safe_filename(F.lit(" a/b  c? ")), "a-b-c"), (lambda: s.safe_filename(F.lit("///")), "store"),
        (lambda: s.relative_path(F.lit("/r/a/b"), "/r"), "a/b"), (lambda: s.uri_to_path(F.lit("file:///a")), "/a"), (lambda: s.uri_to_path(F.lit("http://a")), None), (lambda: s.page_label(F.lit(3), F.lit(4)), "#3-4"), (lambda: s.page_label(F.lit(3), F.lit(3)), "#3"),
        (lambda: s.page_label_from_id(F.lit("a#12")), "#12"), (lambda: s.page_label_from_id(F.lit("a#3-4")), "#3-4"), (lambda: s.page_label_from_id(F.lit("a#3-x")), "#3"), (lambda: s.page_label_from_id(F.lit("a#x")), None),
        (lambda: s.score_text(F.lit(None).cast("double")), "-"), (lambda: s.basename(F.lit("a\\b/c.TXT")), "c.TXT"), (lambda: s.extension(F.lit("/x/.hidden")), ""), (lambda: s.extension(F.lit("/x/a.TXT")), "txt"), (lambda: s.epoch_seconds(F.lit("nope")), None),
        (lambda: s.epoch_seconds(F.lit("1970-01-01T00:00:10Z")), 10), (lambda: s.display_time(F.lit("2024-01-02T03:04:05Z")), "2024/01/02 03:04"), (lambda: s.display_time(F.lit("raw")), "raw"), (lambda: s.meta_value(F.lit('{"a.b": "1"}'), "a.b"), "1"),
        (lambda: s.is_valid_chunk(F.lit("　\n")), False), (lambda: s.vector_preview(F.expr("array(0.5f, -1f)")), "  0.500000  -1.000000"), (lambda: s.vector_lines(F.expr("array(0.5f)")), "0000: 0.500000000000"),
        (lambda: s.decode(F.unhex(F.lit("83658358")), "sjis"), "テス"), (lambda: s.decode(F.unhex(F.lit("EFBBBF41")), "nope"), "A"), (lambda: sentences(F.lit("A. B! tail")), ["A.", "B!", "tail"]), (lambda: sentences(F.lit("  ")), [""]),
        (lambda: analyze.words(F.lit("Foo-bar ÉX 1")), ["foo", "bar", "éx", "1"]), (lambda: analyze.ngrams(2, 3)(F.lit("abc")), ["ab", "abc", "bc"]), (lambda: analyze.ngrams(0, 0)(F.lit("ab")), ["ab"]), (lambda: analyze.cjk_or_words(F.lit("検索する go")), ["go", "検索", "索す", "する"]),
        (lambda: s.from_json_or(F.lit("broken"), "array<string>", F.array(F.lit("d"))), ["d"]),
    ],
)
def test_scalars(spark, column, value):
    assert spark.range(1).select(column()).first()[0] == value


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿text\n 吾輩は猫 \n\nb\n".encode())
    assert [r.text for r in src.read_one_column_csv(spark, f"file://{tmp_path}/c.csv").collect()] == ["吾輩は猫", "b"]
    (tmp_path / "c.ndjson").write_text('{"chunk_id":"a#0","doc_id":"a","text":"x","meta":{"k":"v"},"odd":1}\n\n{"chunk_id":"a#1","doc_id":"a","text":"y","extra":{"z":"2"}}\n')
    rows = {r.chunk_id: r for r in src.read_ndjson(spark, f"file://{tmp_path}/c.ndjson").collect()}
    assert rows["a#0"].extra == '{"odd":"1"}' and rows["a#0"].meta == {"k": "v"} and rows["a#1"].extra == '{"z":"2"}'
    (tmp_path / "bad.ndjson").write_text("{broken\n")
    with pytest.raises(Exception):
        src.read_ndjson(spark, f"file://{tmp_path}/bad.ndjson").collect()


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.txt").write_text("hello\nthere")
    (tmp_path / "a" / "b" / "y.TXT").write_text("deep")
    (tmp_path / "z.bin").write_bytes(b"\0")
    all_files = src.scan(spark, f"file://{tmp_path}", ["txt"]).collect()
    assert {(r.path.rpartition("/")[2], r.preview) for r in all_files} == {("x.txt", "hello there"), ("y.TXT", "deep")}
    assert [r.path.rpartition("/")[2] for r in src.scan(spark, f"file://{tmp_path}", max_depth=0).orderBy("path").collect()] == ["x.txt", "z.bin"]
    assert src.decode_bytes(b"\xff\xfea\0", "utf-16le") == "a" and src.preview_text(b"a\r\nb") == "a\nb"
