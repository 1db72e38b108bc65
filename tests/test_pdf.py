import zlib

import pytest

from lodestar.plans.config import EngineConfig
from lodestar.plans.engine import Engine
from lodestar.sources import files as sources
from lodestar.sources import pdf


def document(*pages: bytes, flate: bool = True, fonts: bytes = b"<< /F1 << /Type /Font /Subtype /Type1 >> /F2 << /Type /Font /Subtype /Type0 /ToUnicode 90 0 R >> >>", more: bytes = b"") -> bytes:
    """A PDF of these content streams."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out = b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [ " + kids + b" ] /Count %d /Resources << /Font " % len(pages) + fonts + b" >> >>\nendobj\n"
    for i, page in enumerate(pages):
        data = zlib.compress(page) if flate else page
        out += b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj\n<< /Length %d %s>>\nstream\n" % (11 + 2 * i, len(data), b"/Filter /FlateDecode " if flate else b"") + data + b"\nendstream\nendobj\n"
    return out + more + b"trailer << /Root 1 0 R >>\n%%EOF"


MAP = b"1 beginbfchar <0001> <65E5> endbfchar 1 beginbfrange <0002> <0004> <672C> endbfrange 1 beginbfrange <0010> <0011> [<0041> <00420043>] endbfrange"
WITH_MAP = b"90 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(MAP), MAP)


@pytest.mark.parametrize("flate", [True, False])
def test_text_operators(flate):
    first = b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\)) Tj 0 -14 Td [(W) 20 (orld) -400 (again\\041)] TJ T* (next) ' ET"
    second = b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 1 0 0 1 72 600 Tm <00100011> Tj ET % (not this)\nBI /W 1 ID (x) EI\n"
    assert pdf.read_pages(document(first, second, b"", flate=flate, more=WITH_MAP)) == ["Hello (you)\nWorld again!\nnext", "日本\nABC", ""]


def test_objects_in_streams_and_damage():
    inner = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [10 0 R] >>"
    first = inner.index(b"<<")
    places = b"1 0 2 %d " % (inner.index(b"<< /Type /Pages") - first)
    packed = zlib.compress(places + inner[first:])
    content = b"%PDF-1.5\n5 0 obj\n<< /Type /ObjStm /N 2 /First " + b"%d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(places), len(packed)) + packed + b"\nendstream\nendobj\n"
    content += b"10 0 obj << /Type /Page /Contents [11 0 R 12 0 R] >> endobj 11 0 obj << /Length 99999 >>\nstream\nBT (a) Tj\nendstream endobj 12 0 obj << /Filter /ASCIIHexDecode >>\nstream\n286229 20546A 204554>\nendstream endobj"
    assert pdf.read_pages(content) == ["ab"]
    for broken in (b"text", b"%PDF-1.4 trailer << /Encrypt 3 0 R >>", document(b"x").replace(b"/FlateDecode", b"/LZWDecode")):
        with pytest.raises(ValueError):
            pdf.read_pages(broken)


def test_pdf_files_reach_the_store(spark, tmp_path):
    page = b"BT /F1 12 Tf 72 700 Td (A first line of the page that is long enough) Tj 0 -14 Td (and its second line) Tj ET"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(document(page, page.replace(b"first", b"third")))
    (tmp_path / "in" / "b.pdf").write_bytes(b"no pdf")
    engine = Engine(spark, EngineConfig(store_root=f"file://{tmp_path}/store", dim=4))
    rejects = engine.ingest_files(f"file://{tmp_path}/in", at="2024-01-01T00:00:00Z").collect()
    assert [r.path.rpartition("/")[2] for r in rejects] == ["b.pdf"]
    assert {(r.page_start, r.page_end) for r in engine.chunks.collect()} == {(1, 2)}
    assert engine.files.first().page_count == 2 and "third line" in engine.chunks.first().text
    assert sources.blocks_of_file("x.pdf", document(page), pdf_backend="none") == (None, [], "no PDF reader is set")
    assert sources.blocks_of_file("x.pdf", b"", pdf_backend=lambda content: ["own text"])[1][0]["text"] == "own text"
