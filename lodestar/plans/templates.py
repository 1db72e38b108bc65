"""Prompt templates: parsed once on the driver into literal and Column parts, rendered by one concat per row."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import scalars

_TOKEN = re.compile(r"<<(.*?)>>", re.S)
_NAME = re.compile(r"\s*(\w+)\s*(?::\s*(\w+)\s*(?:\(\s*(.*?)\s*\))?\s*)?")


def parse_token(body: str) -> tuple[str, str | None, str | None]:
    """(name, transform, argument) of a token's inside."""
    m = _NAME.fullmatch(body)
    return m.groups() if m else (body, None, None)


def transform(value: Column, name: str | None, argument: str | None) -> Column:
    number = int(argument) if argument and argument.isdigit() else None
    if name == "snippet":
        return scalars.snippet(value, 200 if number is None else number)
    if name == "escape_json":
        return scalars.escape_json(value)
    if name == "flatten":
        return scalars.flatten_preview(value, 80 if number is None else number)
    return value


def expand(template: str, values: dict[str, Column]) -> Column:
    """The template with its tokens replaced; unknown names are empty, an unclosed token stays as it is."""
    parts, end = [], 0
    for m in _TOKEN.finditer(template):
        name, tf, argument = parse_token(m.group(1))
        parts.append(F.lit(template[end : m.start()]))
        if name in values:
            parts.append(F.coalesce(transform(values[name].cast("string"), tf, argument), F.lit("")))
        end = m.end()
    return F.concat(*parts, F.lit(template[end:]))


@dataclass(frozen=True)
class PromptTemplate:
    name: str = "default"
    header: str = "Query: <<Query>> (top <<TopK>>)"
    item: str = "<<Rank>>. <<File>> <<Page>>\n<<Text:snippet(200)>><<Comma>>"
    footer: str = ""
    items: int = 5
    prev: int = 1
    next: int = 1


class PromptTemplates:
    """Templates by name: add, rename, remove, merge."""

    def __init__(self, templates: list[PromptTemplate] | None = None):
        self.by_name = {t.name: t for t in templates or [PromptTemplate()]}

    def put(self, template: PromptTemplate) -> None:
        self.by_name[template.name] = template

    def remove(self, name: str) -> None:
        self.by_name.pop(name, None)

    def rename(self, old: str, new: str) -> None:
        self.by_name = {(new if k == old else k): (replace(t, name=new) if k == old else t) for k, t in self.by_name.items()}

    def merge(self, other: PromptTemplates) -> tuple[int, int]:
        """(added, updated) after taking over the other's templates."""
        added = sum(name not in self.by_name for name in other.by_name)
        self.by_name |= other.by_name
        return added, len(other.by_name) - added


def render(hits: DataFrame, template: PromptTemplate, query: str, top_k: int, text: str = "text", order: list[Column] | None = None) -> DataFrame:
    """One row, `prompt`: header, the first items and footer, each ending with a line break.

    hits has rank, chunk_id, source_uri, page_start, page_end and text (the
    context text, where there is one). Only `items` rows are gathered.
    """
    ranked = hits if "rank" in hits.columns else hits.withColumn("rank", F.row_number().over(Window.orderBy(*(order or [F.col("score").desc(), F.col("chunk_id")]))))
    some = ranked.orderBy("rank").limit(max(1, template.items))
    count = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    label = F.coalesce(scalars.page_label(F.col("page_start"), F.col("page_end")), scalars.page_label_from_id(F.col("chunk_id")))
    shared = {"Query": F.lit(query), "TopK": F.lit(top_k)}
    values = shared | {
        "Rank": F.col("rank"), "File": scalars.basename(F.col("source_uri")), "Page": label, "CID": F.col("chunk_id"), "SourceUri": F.col("source_uri"),
        "Text": F.col(text), "Comma": F.when(F.col("rank") < F.col("_n"), ",").otherwise(""),
    }
    items = some.withColumn("_n", count).select("rank", expand(template.item, values).alias("item"))
    ended = lambda c: F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: ended(x["item"])), "")
    return items.agg(F.concat(ended(expand(template.header, shared)), joined, ended(expand(template.footer, shared))).alias("prompt"))


Renderer = Callable[[DataFrame], DataFrame]
