import io
import zipfile

import pytest

from lodestar.sources import office

W = 'xmlns:w="http://w"'


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body, numbering="", styles=""):
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    if numbering:
        parts["word/numbering.xml"] = f"<w:numbering {W}>{numbering}</w:numbering>"
    if styles:
        parts["word/styles.xml"] = f"<w:styles {W}>{styles}</w:styles>"
    return pack(parts)


def par(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def num(level, list_id=1):
    return f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{list_id}"/></w:numPr>'


NUMBERING = (
    '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>'
    '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2"/><w:suff w:val="space"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num>'
)


def test_numbering_of_a_child_before_its_parent():
    blocks = office.read_docx(docx(par("a", num(1)) + par("b", num(0)) + par("c", num(1)), NUMBERING))
    assert [b["text"] for b in blocks] == ["1.1 a", "2.b", "2.1 c"]


def test_numbering_start_override():
    assert [b["text"] for b in office.read_docx(docx(par("a", num(0, 2)) + par("b", num(0, 2)), NUMBERING))] == ["5.a", "6.b"]


def test_headings_by_style_outline_and_based_on_cycle():
    styles = '<w:style w:styleId="Top"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="Sub"><w:basedOn w:val="Top"/></w:style><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style>'
    style = lambda s: f'<w:pStyle w:val="{s}"/>'
    blocks = office.read_docx(docx(par("t", style("Sub")) + par("h", style("Heading2")) + par("p", style("A")), styles=styles))
    assert [(b["kind"], b["heading_level"]) for b in blocks] == [("heading", 1), ("heading", 2), ("paragraph", None)]
    assert blocks[0]["text"] == "t\n"


def test_tables_and_pages():
    cell = lambda *t: "<w:tc>" + "".join(par(x) for x in t) + "</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b', 'c')}</w:tr></w:tbl>"
    blocks = office.read_docx(docx(par("x") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + table))
    assert blocks[1]["page_start"] == 2 and blocks[1]["attrs"] == {"is_table": "true"}
    assert blocks[1]["text"] == '\n<table delim="tsv" cell-nl="U+2028">\na\tb\u2028c\n</table>\n'


@pytest.mark.parametrize(("n", "style", "text"), [(4, "upperRoman", "IV"), (27, "upperLetter", "AA"), (12, "decimalFullWidth", "１２"), (3, "aiueo", "う"), (2, "katakana", "イ"), (0, "lowerRoman", ""), (9, None, "9"), (1994, "lowerRoman", "mcmxciv")])
def test_number_formats(n, style, text):
    assert office.format_number(n, style) == text


R = 'xmlns:r="http://r"'
REL = '<Relationships><Relationship Id="r1" Target="{}"/></Relationships>'


def test_workbook():
    sheet = '<worksheet><sheetData><row><c r="B1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#N/A</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>a\nb</t></is></c></row></sheetData></worksheet>'
    book = pack({"xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format("worksheets/s1.xml"), "xl/worksheets/s1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>"})
    assert [b["text"] for b in office.read_xlsx(book)] == ["Sheet: S\n", "\tx\t3\tTRUE\t#ERR:#N/A\n", "a\u2028b\n"]
    assert office.first_column(book, header=False) == ["a\u2028b"]


def test_slides():
    shape = lambda kind, *texts: "<sp><nvPr>" + (f'<ph type="{kind}"/>' if kind else "") + "</nvPr><txBody>" + "".join(f"<p><r><t>{t}</t></r></p>" for t in texts) + "</txBody></sp>"
    slide = "<sld>" + shape("title", "Hello") + shape(None, "one", "two") + "<graphicFrame><tbl><tr><tc><txBody><p><r><t>cell</t></r></p></txBody></tc></tr></tbl></graphicFrame></sld>"
    deck = pack({"ppt/presentation.xml": f'<presentation {R}><sldIdLst><sldId id="256" r:id="r1"/></sldIdLst></presentation>', "ppt/_rels/presentation.xml.rels": REL.format("slides/s1.xml"), "ppt/slides/s1.xml": slide})
    blocks = office.read_pptx(deck)
    assert [b["text"] for b in blocks[:3]] == ["Slide: Hello\n", "one\n", "two\n"]
    assert "cell" in blocks[3]["text"]


def test_one_column_workbook_and_export(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestar.operators import vector
    from lodestar.sources import files as src

    sheet = '<worksheet><sheetData><row><c r="A1" t="str"><v>text</v></c></row><row><c r="A2" t="str"><v> one </v></c></row><row/><row><c r="A4"><v>2</v></c></row></sheetData></worksheet>'
    book = pack({"xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format("worksheets/s1.xml"), "xl/worksheets/s1.xml": sheet})
    rows = src.read_one_column_workbook(spark.createDataFrame([("b.xlsx", bytearray(book))], "path string, content binary"))
    chunks = src.column_to_chunks(rows, "2024-01-01").orderBy("source_uri").collect()
    assert [(c.text, c.source_uri) for c in chunks] == [("one", "excel://0"), ("2", "excel://1")] and len({c.doc_id for c in chunks}) == 2
    table = vector.export_table(spark.createDataFrame([("t", [0.5, -1.0])], "text string, vec array<float>"), "text", "vec", 2)
    src.write_embedding_export(table, f"file://{tmp_path}/out")
    lines = {line for p in (tmp_path / "out").glob("*.csv") for line in p.read_text().splitlines()}  # each part has the header
    assert lines == {"text,emb_0,emb_1", "t,0.500000,-1.000000"}
    scanned = spark.createDataFrame([("a.b", 2), ("c.a", 1)], "path string, size int")
    assert [r.path for r in src.sort_scan(scanned, "ext").collect()] == ["c.a", "a.b"]
    assert scanned.select(F.max("size")).first()[0] == 2


def test_sql_functions(spark):
    from lodestar.functions.register import register

    assert register(spark) == ["ls_segments", "ls_normalise_page"]
    row = spark.sql("SELECT ls_segments('a b')[0].text AS s, ls_normalise_page('x\n- 1 -') AS p").first()
    assert (row.s, row.p) == ("a b", "x")


def test_open_document_sheets():
    import io
    import zipfile

    from lodestar.sources import office

    t, o, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    rows = (
        '<t:table-row><t:table-cell o:value-type="string"><x:p>head</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"/><t:table-cell o:value-type="float" o:value="3.0"><x:p>3</x:p></t:table-cell></t:table-row>'
        '<t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="boolean" o:boolean-value="true"/><t:table-cell><x:p>a</x:p><x:p>b<x:span>c</x:span></x:p></t:table-cell><t:table-cell t:number-columns-repeated="1000"/></t:table-row>'
        '<t:table-row t:number-rows-repeated="1048576"><t:table-cell t:number-columns-repeated="1024"/></t:table-row>'
    )
    body = f'<o:document-content xmlns:o="{o}" xmlns:t="{t}" xmlns:x="{x}"><o:body><o:spreadsheet><t:table t:name="One">{rows}</t:table></o:spreadsheet></o:body></o:document-content>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("content.xml", body)
    assert office.sheets(out.getvalue()) == [("One", [["head", "", "", "3"], ["TRUE", "a bc"], ["TRUE", "a bc"]])]
    assert [b["kind"] for b in office.read_xlsx(out.getvalue())] == ["heading", "paragraph", "paragraph", "paragraph"]


def test_workbooks_of_an_export(spark):
    from pyspark.sql import functions as F

    from lodestar.operators import vector
    from lodestar.sources import files, office

    rows = spark.createDataFrame([(f"text <{i}> & \x01", [i / 4, -1.0]) for i in range(5)], "text string, vec array<double>").coalesce(1)
    books = files.embedding_workbooks(vector.export_table(rows, "text", "vec", 2), rows_per_book=3).orderBy("part").collect()
    read = [office.sheets(bytes(b.content))[0][1] for b in books]
    assert [len(r) for r in read] == [4, 3] and read[0][0] == ["text", "emb_0", "emb_1"] and read[0][2] == ["text <1> & ", "0.250000", "-1.000000"]
    first = files.read_one_column_workbook(spark.createDataFrame([("b.xlsx", bytearray(books[0].content))], "path string, content binary"))
    assert [r.text for r in first.orderBy(F.col("pos")).collect()] == ["text <0> &", "text <1> &", "text <2> &"]
