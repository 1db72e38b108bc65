"""Filter clauses (a conjunction) compiled to one Column, so Catalyst pushes them to the scan.

A key names a reserved column, or else an entry of the meta map. A missing
value matches nothing; an empty list of values matches nothing; numbers that
don't parse match nothing; a prefix is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.schema import RESERVED


class Kind(Enum):
    MUST = "must"
    PREFER_PRE = "prefer_pre"
    POST_ONLY = "post_only"


@dataclass(frozen=True)
class Clause:
    kind: Kind = Kind.MUST

    def test(self, meta: str) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class DocIdEq(Clause):
    value: str = ""

    def test(self, meta: str) -> Column:
        return F.col("doc_id") == self.value


@dataclass(frozen=True)
class DocIdIn(Clause):
    values: tuple = ()

    def test(self, meta: str) -> Column:
        return F.col("doc_id").isin(*self.values) if self.values else F.lit(False)


@dataclass(frozen=True)
class SourceUriPrefix(Clause):
    prefix: str = ""

    def test(self, meta: str) -> Column:
        return F.col("source_uri").startswith(self.prefix)


@dataclass(frozen=True)
class MetaEq(Clause):
    key: str = ""
    value: str = ""

    def test(self, meta: str) -> Column:
        return resolve(self.key, meta) == self.value


@dataclass(frozen=True)
class MetaIn(Clause):
    key: str = ""
    values: tuple = ()

    def test(self, meta: str) -> Column:
        return resolve(self.key, meta).isin(*self.values) if self.values else F.lit(False)


@dataclass(frozen=True)
class _Range(Clause):
    key: str = ""
    low: object = None
    high: object = None
    low_open: bool = False
    high_open: bool = False

    def value(self, meta: str) -> Column:
        raise NotImplementedError

    def bound(self, x) -> Column:
        return F.lit(x)

    def test(self, meta: str) -> Column:
        value, tests = self.value(meta), []
        if self.low is not None:
            tests.append(value > self.bound(self.low) if self.low_open else value >= self.bound(self.low))
        if self.high is not None:
            tests.append(value < self.bound(self.high) if self.high_open else value <= self.bound(self.high))
        return reduce(Column.__and__, tests, value.isNotNull())


@dataclass(frozen=True)
class RangeNumeric(_Range):
    def value(self, meta: str) -> Column:
        return resolve(self.key, meta).try_cast("double")


@dataclass(frozen=True)
class RangeIsoDate(_Range):
    """Text order by default; as_timestamp compares points in time."""

    as_timestamp: bool = False

    def value(self, meta: str) -> Column:
        raw = resolve(self.key, meta)
        return F.try_to_timestamp(raw) if self.as_timestamp else raw

    def bound(self, x) -> Column:
        return F.try_to_timestamp(F.lit(x)) if self.as_timestamp else F.lit(x)


def resolve(key: str, meta: str = "meta") -> Column:
    return F.col(key).cast("string") if key in RESERVED else F.try_element_at(F.col(meta), F.lit(key))


def predicate(clauses: list[Clause], meta: str = "meta") -> Column:
    """All clauses, null-safe: true or false, never null."""
    return reduce(Column.__and__, [F.coalesce(c.test(meta), F.lit(False)) for c in clauses], F.lit(True))


def split(clauses: list[Clause]) -> tuple[list[Clause], list[Clause]]:
    """Clauses to apply before the top-N is taken, and those only after it."""
    return [c for c in clauses if c.kind is not Kind.POST_ONLY], [c for c in clauses if c.kind is Kind.POST_ONLY]


def keep(df: DataFrame, clauses: list[Clause], meta: str = "meta") -> DataFrame:
    return df.where(predicate(clauses, meta)) if clauses else df
