"""Size-bounded segmentation by scored boundaries, one document per call.

Places and limits are UTF-8 bytes, as the sizes of stored chunks are, or with
`unit="chars"` characters; the merge of short segments always counts
characters. A document's state is sequential,
so it is a function of all its blocks, wrapped in one Arrow pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodestar.functions.scalars import WHITE


@dataclass(frozen=True)
class SegmentParams:
    min_chars: int = 400
    max_chars: int = 600
    cap_chars: int = 800
    penalize_short_line: bool = True
    penalize_page_boundary_no_newline: bool = True
    short_merge_min_chars: int = 100
    unit: str = "bytes"
    block_sep: str = ""


#: scores of kinds of boundaries and what lowers or raises them
BLOCK_END, BLANK_LINE, LINE_END, SENTENCE_END = 1.0, 0.95, 0.8, 0.6
SHORT_LINE, SHORT_LINE_BYTES, PAGE_CHANGE, IN_LEADERS, LEADERS = 0.35, 10, 0.4, 0.6, 3
AFTER_TABLE, BEFORE_TABLE, EARLIER_BEFORE_TABLE = 0.25, -0.3, 0.15

_LINE_ENDS = re.compile(rb"\n\n|\n")
_SENTENCE_ENDS = re.compile("[.!?]|。|！|？".encode())
_LEADER = re.compile("[.]|…|・".encode())
_LEADER_RUN = re.compile("(?:[.]|…|・)+".encode())
#: by characters, a text is a byte for each: its own if it is ASCII, else one of what it counts as
_ONE_BYTE = {0x01: "x", ord("。"): "!", ord("！"): "!", ord("？"): "!", ord("…"): "\x01", ord("・"): "\x01"}
_ONE_BYTE_LEADER, _ONE_BYTE_RUN = re.compile(rb"[.\x01]"), re.compile(rb"[.\x01]+")
Block = dict  # text, page_start, page_end, kind, heading_level, attrs


class _Text:
    """A document's joined blocks with their spans, tables, leader runs and scored boundaries."""

    def __init__(self, blocks: list[Block], params: SegmentParams):
        parts = [(b.get("text") or "").replace("\r", "") for b in blocks]
        if params.block_sep:
            parts = [p + params.block_sep for p in parts[:-1]] + parts[-1:]
        self.text = "".join(parts) if params.unit == "chars" else None
        encoded = [p.encode("utf-8", "surrogatepass") if self.text is None else re.sub("[^\x00-\x7f]", "x", p.translate(_ONE_BYTE)).encode("ascii") for p in parts]
        self.data = b"".join(encoded)
        ends = np.cumsum([len(e) for e in encoded]).tolist()
        self.spans = [(end - len(e), end, b.get("page_start"), b.get("page_end")) for e, end, b in zip(encoded, ends, blocks, strict=True)]
        self.span_starts, self.span_ends = [s[0] for s in self.spans], [s[1] for s in self.spans]
        tables = [(s, e) for (s, e, *_), b in zip(self.spans, blocks, strict=True) if _is_table(b)]
        self.tables = sorted(tables, key=lambda t: t[0])
        self.table_starts = [t[0] for t in self.tables]
        leader, run = (_LEADER, _LEADER_RUN) if self.text is None else (_ONE_BYTE_LEADER, _ONE_BYTE_RUN)
        self.runs = [(m.start(), m.end(), len(leader.findall(m.group()))) for m in run.finditer(self.data)]
        self.run_starts = [r[0] for r in self.runs]
        self._score(params)

    def piece(self, start: int, end: int) -> str:
        return self.data[start:end].decode("utf-8", "surrogatepass") if self.text is None else self.text[start:end]

    def _score(self, params: SegmentParams) -> None:
        lines = [(m.end(), BLANK_LINE if m.end() - m.start() == 2 else LINE_END) for m in _LINE_ENDS.finditer(self.data)]
        ends = [(m.end(), SENTENCE_END) for m in _SENTENCE_ENDS.finditer(self.data)]
        offers = np.array([(end, BLOCK_END) for end in self.span_ends[:-1]] + lines + ends, dtype=np.float64).reshape(-1, 2)
        offers = offers[np.lexsort((-offers[:, 1], offers[:, 0]))]
        places = offers[:, 0].astype(np.int64)
        first = np.ones(len(places), dtype=bool)  # the best offer of each place
        first[1:] = places[1:] != places[:-1]
        places, scores = places[first], offers[first, 1].astype(np.float32)
        starts, stops = (np.array([t[i] for t in self.tables], dtype=np.int64) for i in (0, 1))
        if len(starts):
            at = np.searchsorted(starts, places) - 1  # the last table that starts before the place
            outside = (at < 0) | (places >= stops[at])
            places, scores = places[outside], scores[outside]
        breaks = np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == 10) + 1  # where lines start
        if params.penalize_short_line:
            line = np.searchsorted(breaks, places, side="right") - 1
            line_start = np.where(line >= 0, breaks[line], 0) if len(breaks) else np.zeros_like(places)
            scores[places - line_start < SHORT_LINE_BYTES] -= np.float32(SHORT_LINE)
        if params.penalize_page_boundary_no_newline:
            jumps = [a[1] for a, b in zip(self.spans, self.spans[1:], strict=False) if a[3] is not None and b[2] is not None and a[3] != b[2]]
            if jumps:
                scores[np.isin(places, jumps) & ~np.isin(places, breaks)] -= np.float32(PAGE_CHANGE)
        if self.runs:
            run = np.searchsorted(self.run_starts, places) - 1
            ends_of, leaders = np.array([r[1] for r in self.runs]), np.array([r[2] for r in self.runs])
            scores[(run >= 0) & (leaders[run] >= LEADERS) & (places <= ends_of[run])] -= np.float32(IN_LEADERS)  # inside or just after
        self.places, self.scores = places.tolist(), scores
        for start, end in self.tables:
            at_end, before = bisect_left(self.places, end), bisect_left(self.places, start)
            if at_end < len(self.places) and self.places[at_end] == end:
                self.scores[at_end] += np.float32(AFTER_TABLE)
            for back, change in ((1, BEFORE_TABLE), (2, EARLIER_BEFORE_TABLE)):
                if before >= back:
                    self.scores[before - back] += np.float32(change)

    def choose(self, low: int, high: int, prefer: int) -> int | None:
        """The boundary from low to high of the best score less its distance from prefer; the first of equals."""
        i, j = bisect_left(self.places, low), bisect_left(self.places, high + 1)
        if i >= j:
            return None
        far = np.abs(np.array(self.places[i:j]) - prefer).astype(np.float32)
        return self.places[i + int(np.argmax(self.scores[i:j] - far / np.float32(max(0, high - low) + 1)))]

    def hard_cut(self, start: int, cap: int) -> int:
        """cap, moved to a character's start and out of a run of leaders."""
        inside = lambda at: at < len(self.data) and self.data[at] & 0xC0 == 0x80
        cut = cap
        while cut > start and inside(cut):
            cut -= 1
        if cut <= start:
            cut = min(cap + 1, len(self.data))
            while inside(cut):
                cut += 1
        run = self.runs[i] if (i := bisect_left(self.run_starts, cut) - 1) >= 0 else (0, -1)
        return max(start + 1, run[0]) if cut <= run[1] else cut

    def pages(self, start: int, end: int) -> tuple[int | None, int | None]:
        over = self.spans[bisect_right(self.span_ends, start) : bisect_left(self.span_starts, end)]
        return min((s[2] for s in over if s[2] is not None), default=None), max((s[3] for s in over if s[3] is not None), default=None)


def _is_table(block: Block) -> bool:
    flag = (block.get("attrs") or {}).get("is_table")
    return flag == "true" if flag is not None else (block.get("text") or "").lstrip(WHITE).startswith("<table ")


def boundaries(blocks: list[Block], params: SegmentParams = SegmentParams()) -> list[tuple[int, float]]:
    """(place, score) of every boundary of a document."""
    text = _Text(blocks, params)
    return list(zip(text.places, map(float, text.scores), strict=True))


def _cut(text: _Text, start: int, params: SegmentParams) -> int:
    total = len(text.data)
    low, prefer, cap = (min(total, start + n) for n in (params.min_chars, params.max_chars, params.cap_chars))
    cut = text.choose(low, cap, prefer)
    if cut is not None and cut > start:
        table = text.tables[i] if (i := bisect_left(text.table_starts, start)) < len(text.tables) else None
        if table and cut <= table[0] and table[1] <= cap:  # keep what stands before a table with it
            at = bisect_left(text.places, table[0])
            if at and (earlier := text.places[at - 2 if at > 1 else at - 1]) >= low:
                cut = earlier
        if cut > start:
            return cut
    hard = text.hard_cut(start, cap)
    after = bisect_left(text.places, cap + 1)
    cut = min(hard, text.places[after] if after < len(text.places) else text.places[-1] if text.places else hard)
    cut = cut if cut > start else hard
    return cut if cut > start else total


def segment(blocks: list[Block], params: SegmentParams = SegmentParams()) -> list[tuple[str, int | None, int | None]]:
    """(text, page_start, page_end) of each segment; one empty segment for blank input."""
    text = _Text(blocks, params)
    out, start, total = [], 0, len(text.data)
    if not text.piece(0, total).strip(WHITE):
        return [("", None, None)]
    while start < total:
        end = total if start + params.min_chars >= total else _cut(text, start, params)
        if piece := text.piece(start, end).rstrip(WHITE):
            out.append((piece, *text.pages(start, end)))
        start = end
    return _merge_short(out, params) or [("", None, None)]


def _merge_short(pieces: list, params: SegmentParams) -> list:
    out: list = []
    least = lambda f, a, b: f((x for x in (a, b) if x is not None), default=None)
    for text, first, last in pieces:
        if out and len(text) <= params.short_merge_min_chars and len(out[-1][0]) + len(text) <= params.cap_chars:
            before, a, b = out[-1]
            joined = before + ("" if before.endswith("\n") else "\n") + text
            out[-1] = (joined, least(min, a, first), least(max, b, last))
        else:
            out.append((text, first, last))
    return out


def group_blocks(blocks: list[Block], by: str = "none") -> list[list[Block]]:
    """Blocks of one document in groups that no segment crosses: `h1`, `levels` (the two cut levels) or `none`."""
    heading = lambda b: b.get("heading_level") if b.get("kind") == "heading" else None
    if by == "none" or not blocks:
        return [blocks] if blocks else []
    if by == "h1":
        chapter, section, cuts = None, None, {1}
    else:
        levels = [heading(b) for b in blocks]
        cuts_in_order = [n for n in range(1, 10) if levels.count(n) >= 2][:2]
        chapter, section = (*cuts_in_order, None, None)[:2]
        cuts = set(cuts_in_order)
    groups: list[list[Block]] = [[]]
    for block in blocks:
        level = heading(block)
        together = section is not None and level == section and len(groups[-1]) == 1 and heading(groups[-1][0]) == chapter
        if level in cuts and groups[-1] and not together:
            groups.append([])
        groups[-1].append(block)
    return groups


SEGMENTS = ArrayType(StructType([StructField("text", StringType()), StructField("page_start", LongType()), StructField("page_end", LongType())]))


def segment_document(blocks: list[Block], params: SegmentParams = SegmentParams(), group: str = "none") -> list[tuple]:
    return [s for part in group_blocks(blocks, group) for s in segment(part, params)]


def segments_of_text(text: Column, params: SegmentParams = SegmentParams()) -> Column:
    """Array of segments of a text column: its paragraphs (between blank lines) are the blocks."""

    @F.pandas_udf(SEGMENTS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("text", "page_start", "page_end"), s, strict=True)) for s in segment(text_blocks(t or ""), params)])

    return run(text)


def text_blocks(text: str) -> list[Block]:
    """Paragraph blocks of a plain text; one empty block if there are none."""
    parts = [p.strip(WHITE) for p in re.split(r"\n{2,}", text.replace("\r", ""))]
    return [{"kind": "paragraph", "text": p} for p in parts if p] or [{"kind": "paragraph", "text": ""}]


def segment_blocks(blocks: DataFrame, params: SegmentParams = SegmentParams(), group: str = "none") -> DataFrame:
    """(doc_id, pos, text, page_start, page_end) of a blocks table: each document's blocks in one call, whatever their number of documents."""
    per_doc = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "text", "page_start", "page_end", "heading_level", F.map_entries("attrs").alias("attrs")))).alias("blocks"))

    @F.pandas_udf(SEGMENTS)
    def run(docs: pd.Series) -> pd.Series:
        whole = lambda b: dict(b) | {"attrs": {e["key"]: e["value"] for e in b["attrs"]} if b["attrs"] is not None else {}}
        return docs.map(lambda d: [dict(zip(("text", "page_start", "page_end"), s, strict=True)) for s in segment_document([whole(b) for b in d], params, group)])

    return per_doc.select("doc_id", F.posexplode(run("blocks")).alias("pos", "s")).select("doc_id", "pos", "s.*")


def chunks_of(segments: DataFrame) -> DataFrame:
    """Segments with chunk_id (`doc#pos`) and ord; blank ones go."""
    out = segments.withColumns({"chunk_id": F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string")), "ord": F.col("pos").cast("long")})
    return out.where(F.regexp_replace("text", f"[{WHITE}]", "") != "")


_END, _MARK = ".!?。！？", "\uffff"


def sentences(text: Column, white: str = WHITE, blank: str | None = "") -> Column:
    """Array of sentences: split after . ! ? and their full-width forms, trimmed of white, blank ones dropped.

    A text without sentences gives one that is `blank`, or none for blank=None; with that, null gives null.
    """
    marked = text
    for end in _END:
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    # a text that holds the mark itself (it is no character) is split by the pattern
    by_pattern = F.regexp_extract_all(text, F.lit(f"(?s)[^{_END}]*[{_END}]|[^{_END}]+$"), F.lit(0))
    parts = F.when(F.contains(text, F.lit(_MARK)), by_pattern).otherwise(F.split(marked, _MARK))
    kept = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(white))), lambda p: p != "")
    if blank is None:
        return kept
    one = F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit(blank))))  # kept stands once in the plan
    return F.get(one, F.lit(0))
