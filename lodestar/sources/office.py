"""Readers of office documents: bytes to blocks, by the standard library's zip and XML.

A block is a dict of kind, text, page_start, page_end, heading_level, attrs.
Each reader takes a whole file's bytes; they run inside mapInPandas, one file
at a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

CELL_BREAK = "\u2028"
_PLAIN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")  # what XML can't hold
#: kana order of list numbers (fixed values)
KATAKANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン"
HIRAGANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def block(kind: str, text: str, page: int | None = None, level: int | None = None, **attrs: str) -> dict:
    return {"kind": kind, "text": text, "page_start": page, "page_end": page, "heading_level": level, "attrs": attrs}


def name_of(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def attr(node, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def child(node, *path: str):
    for step in path:
        node = next((c for c in node if name_of(c) == step), None) if node is not None else None
    return node


def _xml(archive: zipfile.ZipFile, path: str):
    try:
        return ElementTree.fromstring(archive.read(path))
    except (KeyError, ElementTree.ParseError):
        return None


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _xml(archive, f"{folder}/_rels/{name}.rels")
    target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {} if root is None else {attr(r, "Id"): target(attr(r, "Target") or "") for r in root}


def table_text(rows: list[list[str]]) -> str:
    body = "\n".join("\t".join(cell.replace("\n", CELL_BREAK) for cell in row) for row in rows)
    return f'<table delim="tsv" cell-nl="U+2028">\n{body}\n</table>\n'


# --- numbers of lists ---


def format_number(n: int, style: str | None) -> str:
    n, style = max(0, n), (style or "decimal").lower()
    kana = KATAKANA if "katakana" in style or style == "aiueofullwidth" else HIRAGANA if "hiragana" in style or style == "aiueo" else None
    if kana:
        return "" if n == 0 else kana[n - 1] if n <= len(kana) else str(n)
    if style == "decimalfullwidth":
        return str(n).translate({ord(str(d)): chr(0xFF10 + d) for d in range(10)})
    if style in ("upperroman", "lowerroman"):
        out = ""
        for value, sign in ROMAN:
            out += sign * (n // value)
            n %= value
        return out if style == "upperroman" else out.lower()
    if style in ("upperletter", "lowerletter"):
        out = ""
        while n > 0:
            n, digit = divmod(n - 1, 26)
            out = chr(65 + digit) + out
        return out if style == "upperletter" else out.lower()
    return str(n)


class Numbering:
    """Definitions of numbering.xml and the counters of one document."""

    def __init__(self, root):
        self.levels: dict[str, dict[int, dict]] = {}
        self.lists: dict[str, tuple[str, dict[int, int]]] = {}
        self.styles: dict[str, tuple[int, str]] = {}
        self.counters: dict[str, list[int]] = {}
        for node in root if root is not None else ():
            if name_of(node) == "abstractNum":
                self._define(attr(node, "abstractNumId"), node)
            elif name_of(node) == "num":
                starts = {int(attr(o, "ilvl")): int(attr(s, "val")) for o in node if name_of(o) == "lvlOverride" and (s := child(o, "startOverride")) is not None}
                self.lists[attr(node, "numId")] = (attr(child(node, "abstractNumId"), "val"), starts)

    def _define(self, number: str, node) -> None:
        here = self.levels.setdefault(number, {})
        for level in (c for c in node if name_of(c) == "lvl"):
            at = int(attr(level, "ilvl") or 0)
            value = lambda tag, level=level: attr(child(level, tag), "val")
            here[at] = {"text": value("lvlText"), "style": value("numFmt"), "suffix": value("suff"), "start": int(value("start") or 0)}
            if (bound := value("pStyle")) and self.styles.get(bound, (99, ""))[0] > at:
                self.styles[bound] = (at, number)

    def of_style(self, style: str | None) -> tuple[str, int] | None:
        """List and level that a paragraph style is bound to; the smallest list of that definition."""
        if style not in self.styles:
            return None
        level, number = self.styles[style]
        lists = sorted((int(k) for k, (of, _) in self.lists.items() if of == number))
        return (str(lists[0]), level) if lists else None

    def prefix(self, list_id: str, level: int) -> str:
        """The next number of a list's level as its text, with its suffix."""
        if list_id not in self.lists or self.lists[list_id][0] not in self.levels:
            return ""
        of, starts = self.lists[list_id]
        defined = self.levels[of]
        first = lambda at: starts[at] if at in starts else defined.get(at, {}).get("start") or 1
        counts = self.counters.setdefault(list_id, [0] * 9)
        counts[level + 1 :] = [0] * len(counts[level + 1 :])
        for above in range(level):
            counts[above] = counts[above] or first(above)
        counts[level] = counts[level] + 1 if counts[level] else first(level)
        here = defined.get(level, {})
        shown = lambda m: format_number(counts[int(m.group(1)) - 1], defined.get(int(m.group(1)) - 1, {}).get("style")) if 1 <= int(m.group(1)) <= 9 else m.group()
        text = re.sub(r"%(\d+)", shown, "%1" if here.get("text") is None else here["text"])
        return text + {"tab": "\t", "space": " "}.get((here.get("suffix") or "").lower(), "")


def style_levels(root) -> dict[str, int]:
    """Heading level by style id: the name headingN, or the outline level of the style or of one it is based on."""
    own, based = {}, {}
    for style in (s for s in root if name_of(s) == "style") if root is not None else ():
        sid = attr(style, "styleId")
        outline = attr(child(style, "pPr", "outlineLvl"), "val")
        own[sid], based[sid] = int(outline) + 1 if outline and outline.isdigit() else None, attr(child(style, "basedOn"), "val")
    out = {}
    for sid in own:
        at, seen = sid, set()
        while at in own and own[at] is None and at not in seen:
            seen.add(at)
            at = based.get(at)
        named = re.fullmatch(r"heading([1-9])", (sid or "").lower())
        level = int(named.group(1)) if named else own.get(at)
        if level and 1 <= level <= 9:
            out[sid] = level
    return out


def _run_text(node) -> str:
    out = ""
    for part in node.iter():
        kind = name_of(part)
        if kind == "t":
            out += part.text or ""
        elif kind == "tab":
            out += "\t"
        elif kind in ("br", "cr") and attr(part, "type") != "page":
            out += "\n"
    return out


def read_docx(content: bytes) -> list[dict]:
    """Paragraphs, headings (text ends with a line break), tables; pages by explicit page breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = child(_xml(archive, "word/document.xml"), "body")
        numbering, levels = Numbering(_xml(archive, "word/numbering.xml")), style_levels(_xml(archive, "word/styles.xml"))
    out, page = [], 1
    for node in body if body is not None else ():
        breaks = sum(1 for x in node.iter() if name_of(x) == "br" and attr(x, "type") == "page")
        if name_of(node) == "p":
            style = attr(child(node, "pPr", "pStyle"), "val")
            outline = attr(child(node, "pPr", "outlineLvl"), "val")
            level = int(outline) + 1 if outline and outline.isdigit() and int(outline) < 9 else levels.get(style) or _named_level(style)
            listed = child(node, "pPr", "numPr")
            at = (attr(child(listed, "numId"), "val"), int(attr(child(listed, "ilvl"), "val") or 0)) if listed is not None and child(listed, "numId") is not None else numbering.of_style(style)
            text = _run_text(node)
            if text.strip():
                text = (numbering.prefix(*at) if at else "") + text
                out.append(block("heading", text + "\n", page, level) if level else block("paragraph", text, page))
        elif name_of(node) == "tbl":
            rows = [["\n".join(_run_text(p) for p in cell.iter() if name_of(p) == "p") for cell in row if name_of(cell) == "tc"] for row in node if name_of(row) == "tr"]
            lead = "" if not out or out[-1]["text"].endswith("\n") else "\n"
            out.append(block("table", lead + table_text(rows), page, is_table="true"))
        page += breaks
    return out


def _named_level(style: str | None) -> int | None:
    named = re.fullmatch(r"heading([1-9])", (style or "").lower())
    return int(named.group(1)) if named else None


def read_pptx(content: bytes) -> list[dict]:
    """A heading per slide (its first title, or its number), then its paragraphs and tables in order."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        show = "ppt/presentation.xml"
        root, relations = _xml(archive, show), _relations(archive, show)
        ids = [attr_of_relation(s) for s in child(root, "sldIdLst")] if root is not None and child(root, "sldIdLst") is not None else []
        for number, part in enumerate((relations[i] for i in ids if i in relations), 1):
            slide = _xml(archive, part)
            title, parts = None, []
            for shape in slide.iter() if slide is not None else ():
                if name_of(shape) == "sp":
                    kind = next((attr(p, "type") for p in shape.iter() if name_of(p) == "ph"), None)
                    texts = [t for p in shape.iter() if name_of(p) == "p" and (t := _run_text(p)).strip()]
                    if kind in ("title", "ctrTitle") and title is None and texts:
                        title = " ".join(texts)
                    else:
                        parts += [block("paragraph", t + "\n", number) for t in texts]
                elif name_of(shape) == "tbl":
                    rows = [["\n".join(_run_text(p) for p in cell.iter() if name_of(p) == "p") for cell in row if name_of(cell) == "tc"] for row in shape if name_of(row) == "tr"]
                    parts.append(block("table", table_text(rows), number, is_table="true"))
            out.append(block("heading", f"Slide: {title}\n" if title else f"Slide {number}\n", number, 1))
            out += parts
    return out


def attr_of_relation(node) -> str | None:
    """The relation id (the namespaced id, not the plain one) of a slide or sheet entry."""
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), None)


def format_cell(kind: str | None, value: str | None) -> str:
    """A cell's text: whole numbers without decimals, TRUE/FALSE, #ERR: and the error, breaks as U+2028."""
    if value is None:
        return ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind == "e":
        return f"#ERR:{value}"
    if kind in (None, "n"):
        try:
            number = float(value)
        except ValueError:
            return value
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return value.replace("\r\n", "\n").replace("\n", CELL_BREAK)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of every sheet, with empty columns to the left kept."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = "xl/workbook.xml"
        if book not in archive.namelist() and "content.xml" in archive.namelist():
            return _open_document_sheets(_xml(archive, "content.xml"))
        root, relations = _xml(archive, book), _relations(archive, book)
        table = _xml(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in item.iter() if name_of(t) == "t") for item in table] if table is not None else []
        entries = [(attr(s, "name"), attr_of_relation(s)) for s in child(root, "sheets")] if root is not None and child(root, "sheets") is not None else []
        for name, relation in entries:
            sheet, rows = _xml(archive, relations.get(relation, "")), []
            for row in (r for r in sheet.iter() if name_of(r) == "row") if sheet is not None else ():
                cells: list[str] = []
                for cell in (c for c in row if name_of(c) == "c"):
                    kind, value = attr(cell, "t"), getattr(child(cell, "v"), "text", None)
                    if kind == "s":
                        kind, value = "str", shared[int(value)] if value and int(value) < len(shared) else None
                    elif kind == "inlineStr":
                        kind, value = "str", "".join(t.text or "" for t in cell.iter() if name_of(t) == "t")
                    at = _column(attr(cell, "r") or "")
                    cells += [""] * (max(at, len(cells)) - len(cells)) if at >= 0 else []
                    cells.append(format_cell(kind, value))
                rows.append(cells)
            out.append((name, rows))
    return out


def _open_document_sheets(root) -> list[tuple[str, list[list[str]]]]:
    """Sheets of an OpenDocument spreadsheet; repeated cells and rows are written out, but not empty ones at the ends."""
    out = []
    for table in (t for t in (root.iter() if root is not None else ()) if name_of(t) == "table"):
        rows: list[list[str]] = []
        for row in (r for r in table.iter() if name_of(r) == "table-row"):
            cells: list[str] = []
            for cell in (c for c in row if name_of(c) in ("table-cell", "covered-table-cell")):
                kind = attr(cell, "value-type")
                if kind == "boolean":
                    text = format_cell("b", "1" if attr(cell, "boolean-value") == "true" else "0")
                elif kind in ("float", "percentage", "currency"):
                    text = format_cell("n", attr(cell, "value"))
                else:
                    text = format_cell("str", "\n".join("".join(p.itertext()) for p in cell if name_of(p) == "p"))
                cells.append((text, int(attr(cell, "number-columns-repeated") or 1)))
            while cells and not cells[-1][0]:
                cells.pop()
            written = [text for text, n in cells for _ in range(n)]
            rows.append((written, int(attr(row, "number-rows-repeated") or 1)))
        while rows and not rows[-1][0]:
            rows.pop()
        out.append((attr(table, "name") or "", [list(cells) for cells, n in rows for _ in range(n)]))
    return out


def write_workbook(rows: list[list[str]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet of text cells."""
    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    cell = lambda r, c, text: f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(_PLAIN.sub("", text or ""))}</t></is></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, text) for c, text in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packages = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def read_xlsx(content: bytes) -> list[dict]:
    """A heading per sheet, then a paragraph per row that isn't blank: cells by tabs, empty ends cut."""
    out = []
    for number, (name, rows) in enumerate(sheets(content), 1):
        out.append(block("heading", f"Sheet: {name}\n", number, 1))
        for cells in rows:
            text = "\t".join(cells).rstrip("\t")
            if text.strip():
                out.append(block("paragraph", text + "\n", number))
    return out


def first_column(content: bytes, header: bool = True) -> list[str]:
    """Texts of the first column of the first sheet, without the header row and empty cells."""
    book = sheets(content)
    cells = [row[0].strip() if row else "" for row in book[0][1]] if book else []
    return [c for c in cells[int(header) :] if c]
