import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.operators.segment import SegmentParams, _Text, boundaries, group_blocks, segment, segment_blocks, text_blocks


def squeeze(text):
    return "".join(text.split())


def test_short_text_is_one_segment():
    assert segment([{"text": "a" * 300 + "  "}]) == [("a" * 300, None, None)]


def test_blank_input_is_one_empty_segment():
    assert segment([{"text": " \n "}]) == [("", None, None)]


def test_boundary_choice_weighs_score_and_distance():
    text = _Text([{"text": ""}], SegmentParams())
    text.places, text.scores = [500, 600], __import__("numpy").array([0.6, 0.6], dtype="float32")
    assert text.choose(400, 800, 600) == 600
    assert text.choose(601, 800, 700) is None


@pytest.mark.parametrize(("first", "second", "pieces"), [(600, 90, 1), (750, 90, 2)])
def test_short_segments_join_the_one_before(first, second, pieces):
    from lodestar.operators.segment import _merge_short

    out = _merge_short([("x" * first, 1, 1), ("y" * second, 2, 3)], SegmentParams())
    assert len(out) == pieces
    if pieces == 1:
        assert len(out[0][0]) == first + 1 + second and out[0][1:] == (1, 3)


def test_pages_span_the_overlapping_blocks():
    blocks = [{"text": "a" * 500 + "\n", "page_start": 1, "page_end": 1}, {"text": "b" * 500, "page_start": 2, "page_end": 2}]
    assert segment(blocks, SegmentParams(penalize_short_line=False)) == [("a" * 500, 1, 1), ("b" * 500, 2, 2)]


def test_every_boundary_after_a_line_break_is_penalised():
    assert dict(boundaries([{"text": "a long enough line\nx"}]))[19] == pytest.approx(0.45)


def test_dot_leaders_are_not_cut():
    scores = dict(boundaries([{"text": "Contents........12"}]))
    assert all(v < 0.1 for v in scores.values())


def test_no_cut_inside_a_table():
    table = '<table delim="tsv">\n' + "a\tb\n" * 40 + "</table>\n"
    pieces = segment([{"text": "intro. " * 80}, {"text": table}, {"text": "after. " * 80}])
    assert sum("<table" in p[0] and "</table>" in p[0] for p in pieces) == 1


def test_groups_by_h1_and_by_cut_levels():
    h = lambda n: {"kind": "heading", "text": f"h{n}", "heading_level": n}
    p = {"kind": "paragraph", "text": "p"}
    assert [len(g) for g in group_blocks([p, h(1), p, h(1)], "h1")] == [1, 2, 1]
    blocks = [h(2), h(3), p, h(3), p, h(2), h(3)]
    assert [len(g) for g in group_blocks(blocks, "levels")] == [3, 2, 2]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n。あé・…", max_size=4000))
def test_segments_keep_everything_and_stay_below_the_cap(text):
    params = SegmentParams(min_chars=40, max_chars=60, cap_chars=80, short_merge_min_chars=0)
    pieces = segment(text_blocks(text), params)
    assert squeeze("".join(p[0] for p in pieces)) == squeeze("".join(b["text"] for b in text_blocks(text)))
    assert all(len(p[0].encode()) <= 81 for p in pieces)


def test_all_documents(sf_dir):
    for (text,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall():
        assert squeeze("".join(p[0] for p in segment(text_blocks(text)))) == squeeze(text)


def test_blocks_table(spark):
    rows = [("d", i, "paragraph", f"block {i}. " * 30, i, i, None, {}) for i in range(6)]
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, kind string, text string, page_start long, page_end long, heading_level int, attrs map<string,string>")
    out = segment_blocks(blocks).orderBy("pos").collect()
    want = segment([{"text": r[3], "page_start": r[4], "page_end": r[5]} for r in rows])
    assert [(r.text, r.page_start, r.page_end) for r in out] == want


def test_limits_in_characters():
    """A character counts one, whatever its bytes; for ASCII both units agree."""
    import random

    from lodestar.operators.segment import SegmentParams, boundaries, segment

    rng = random.Random(4)
    words = ["word", "漢字", "ひらがな。", "end.", "naïve", "……", "line\n", "😀!", "・・・・"]
    params = SegmentParams(min_chars=40, max_chars=60, cap_chars=80, short_merge_min_chars=0, unit="chars")
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200)))
        parts = [t for t, *_ in segment([{"kind": "paragraph", "text": text}], params)]
        assert all(len(p) <= 80 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
        assert all(len(p.rstrip()) >= 35 for p in parts[:-1] if "\n" not in p)
        plain = text.encode("ascii", "ignore").decode()
        for unit in ("chars", "bytes"):
            both = SegmentParams(40, 60, 80, short_merge_min_chars=0, unit=unit)
            assert segment([{"text": plain}], both) == segment([{"text": plain}], SegmentParams(40, 60, 80, short_merge_min_chars=0))
    assert [at for at, _ in boundaries([{"text": "漢。a.\nb"}], SegmentParams(unit="chars"))] == [2, 4, 5]
    assert [at for at, _ in boundaries([{"text": "漢。a.\nb"}])] == [6, 8, 9]


def test_a_long_document_takes_time_in_its_length():
    import time

    from lodestar.operators.segment import segment

    def took(n):
        blocks = [{"text": f"Sentence {i} of a page. And one more of it.\n", "page_start": i // 20, "page_end": i // 20} for i in range(n)]
        began = time.perf_counter()
        assert len(segment(blocks)) > n // 20
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 20 * max(took(10_000), 0.05)
