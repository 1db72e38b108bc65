"""Scalar functions as Column expressions: previews, labels, paths, times, JSON and vector text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_valid_chunk(text: Column) -> Column:
    """True for text that isn't blank."""
    return F.coalesce(strip(text) != "", F.lit(False))


def truncate(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there are more; empty for n = 0."""
    return F.when(F.lit(n) <= 0, "").when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def flatten_preview(text: Column, n: int = 80) -> Column:
    """One line: line breaks and tabs become spaces, then truncate()."""
    return truncate(F.translate(text, "\n\r\t", "   "), n)


def snippet(text: Column, n: int = 200) -> Column:
    return truncate(text, n)


def escape_json(text: Column) -> Column:
    """text as the inside of a JSON string."""
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for code in range(32):
        if chr(code) not in "\n\r\t":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def escape_tabs(text: Column) -> Column:
    """Tabs shown as backslash t, carriage returns dropped."""
    return F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit(""))


def humanize_bytes(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(n < (1 << (power + 10)), F.format_string(f"%.1f {unit}", n / float(1 << power))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def display_time(iso: Column) -> Column:
    """ISO time as YYYY/MM/DD HH:MM, other text as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "yyyy/MM/dd HH:mm"), iso)


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def epoch_seconds(iso: Column) -> Column:
    """Whole seconds since 1970 of an ISO time, null if it isn't one."""
    return F.unix_seconds(F.try_to_timestamp(iso))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def safe_filename(name: Column, fallback: str = "store") -> Column:
    """Forbidden characters, control characters and spaces become one dash; none at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x20\x7f]', "-"), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def uri_to_path(uri: Column) -> Column:
    """Path of a file URI or a bare path; null for other schemes."""
    return F.when(uri.startswith("file://"), F.regexp_replace(uri, "^file://", "")).when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit(None)).otherwise(uri)


def page_label(start: Column, end: Column) -> Column:
    """`#n`, or `#a-b` for several pages; null without a page."""
    whole = F.concat(F.lit("#"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(start.isNull(), F.lit(None)).when(end.isNull() | (end == start), F.concat(F.lit("#"), start.cast("string"))).otherwise(whole)


def page_label_from_id(chunk_id: Column) -> Column:
    """Page label from an id's tail: `x#3-4` gives `#3-4`, `x#3-x` gives `#3`, others null."""
    tail = F.regexp_extract(chunk_id, "#([0-9]+(?:-[0-9]+)?)(?:-[^#]*)?$", 1)
    return F.when(tail == "", F.lit(None)).otherwise(F.concat(F.lit("#"), tail))


def score_text(score: Column) -> Column:
    return F.when(score.isNull(), "-").otherwise(F.format_string("%.4f", score))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def meta_value(column: Column, key: str) -> Column:
    """Value of a key of JSON text; the key may hold dots and quotes."""
    return F.from_json(column, "map<string,string>").getItem(key)


def to_json_text(value: Column) -> Column:
    return F.to_json(value)


def from_json_or(text: Column, ddl: str, default: Column) -> Column:
    """Parsed JSON, or default where it doesn't parse."""
    return F.coalesce(F.from_json(text, ddl), default)


def hash_unit(*values: Column) -> Column:
    """A double from -1 to 1 from the hash of values."""
    return (F.xxhash64(*values).cast("double") + 9223372036854775808.0) / 18446744073709551615.0 * 2 - 1


def _cells(form: str):
    """A function from vectors to the texts of each one's components, null for null; it needs no module of this library where it runs."""

    def cells(vectors: pa.Array):
        flat = vectors.flatten()
        numbers = flat.to_pylist() if flat.null_count else flat.to_numpy(zero_copy_only=False).tolist()
        texts, at = [None if x is None else form % x for x in numbers], 0
        for n in vectors.value_lengths().to_pylist():
            yield None if n is None else texts[at : at + n]
            at += n or 0

    return cells


def number_texts(vec: Column, form: str) -> Column:
    """Each component by a C number format, of its exact value (a tie goes to the even digit; Java's formatter rounds it up). Nulls stay."""

    cells = _cells(form)

    @F.arrow_udf("array<string>")
    def run(vectors: pa.Array) -> pa.Array:
        return pa.array(list(cells(vectors)), pa.list_(pa.string()))

    return run(vec.cast("array<double>"))


def vector_preview(vec: Column, per_row: int = 8, most: int = 256) -> Column:
    """Rows of `%10.6f` components; nulls are left out."""
    cells = _cells("%10.6f")

    @F.arrow_udf("string")
    def run(vectors: pa.Array) -> pa.Array:
        rows = lambda v: (" ".join(x for x in v[i : i + per_row] if x is not None) for i in range(0, len(v), per_row))
        return pa.array([None if v is None else "\n".join(rows(v)) for v in cells(vectors)], pa.string())

    return run(F.slice(vec, 1, most).cast("array<double>"))


def vector_lines(vec: Column) -> Column:
    """One `index: value` line per component; nulls are left out."""
    return F.array_join(F.transform(number_texts(vec, "%.12f"), lambda x, i: F.concat(F.format_string("%04d: ", i), x)), "\n")


def decode(content: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text by an encoding's label; unknown labels are UTF-8. A byte order mark goes."""
    names = {
        "utf-8": "UTF-8", "utf8": "UTF-8", "shift_jis": "windows-31j", "sjis": "windows-31j", "cp932": "windows-31j", "windows-31j": "windows-31j",
        "windows-1252": "windows-1252", "cp1252": "windows-1252", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
    }
    name = names.get(encoding.lower(), "UTF-8")
    text = F.call_function("make_valid_utf8", content.cast("string")) if name == "UTF-8" else F.decode(content, name)
    return F.regexp_replace(text, "^﻿", "")
