"""URL filter: rules first, then logistic regression on hashed character n-grams.

Rules name a host (with all its subdomains) and the start of a path; the
longest that fits decides. URLs without a rule get the verdict of a logistic
regression on hashed n-grams of host and path, trained from a small labelled
table of URLs: at most MAX_LABELLED of each verdict. Host, path and rules are
Catalyst expressions; the model's scores come from one vectorised pass over
the URLs alone, without a shuffle.

Defined results: a null URL or one without `://` has empty host and path; no
rule fits it, so the model judges it. Of rules of one length that fit, the
later in the list decides. Without labelled URLs all unruled URLs
are allowed; with one verdict only, they get that one. Repeated rows are rows
of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestar.llm.common import ascii_lower, ship

#: (verdict, host, start of path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MAX_LABELLED = 2000
BUCKETS = 1 << 16
SIZES = (2, 3, 4, 5)


def host_of(url: str = "url") -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(F.col(url), "://([^/?#]*)", 1), F.lit("")))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), "://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (with host and path) plus rule (host and path, or null) and ruled (its verdict)."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule goes before the shorter ones
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return df.withColumns({"rule": rule, "ruled": ruled})


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of host and path, marked at the ends."""
    raw = [f"\x02{h}\x03{p}\x04".encode() for h, p in zip(hosts, paths, strict=True)]
    codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    in_path = np.cumsum(codes == 3) - np.cumsum(codes == 2)  # -1 in the host, 0 in the path
    rows, buckets = [], []
    for size in SIZES:
        if len(codes) < size:
            continue
        n = len(codes) - size + 1
        total = np.full(n, size, dtype=np.uint64) + (in_path[:n] == 0).astype(np.uint64) * np.uint64(977)
        for i in range(size):
            total = (total ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        same = row[:n] == row[size - 1 :]
        rows.append(row[:n][same])
        buckets.append((total[same] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _logits(hosts: list[str], paths: list[str], model: dict) -> np.ndarray:
    if not hosts:
        return np.zeros(0)
    rows, buckets = grams(hosts, paths)
    count = np.maximum(1, np.bincount(rows, minlength=len(hosts)))
    return np.bincount(rows, weights=model["w"][buckets], minlength=len(hosts)) / np.sqrt(count) + model["bias"]


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4) -> dict:
    """Weights and bias by full-batch steps on the mean logistic loss; classes weigh the same."""
    model = {"w": np.zeros(BUCKETS), "bias": 0.0}
    if not len(blocked):
        return model | {"bias": -1.0}
    if blocked.min() == blocked.max():
        return model | {"bias": 1.0 if blocked[0] else -1.0}
    weight = np.where(blocked == 1, 0.5 / max(1, (blocked == 1).sum()), 0.5 / max(1, (blocked == 0).sum()))
    rows, buckets = grams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(hosts))))
    square_w, square_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=model["w"][buckets], minlength=len(hosts)) * scale + model["bias"], -30, 30)))
        error = (p - blocked) * weight
        step = np.bincount(buckets, weights=(error * scale)[rows], minlength=BUCKETS) + ridge * model["w"] / len(blocked)
        square_w += step**2
        square_b += error.sum() ** 2
        model["w"] -= rate * step / np.sqrt(square_w)
        model["bias"] -= rate * error.sum() / np.sqrt(square_b)
    return model


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The model from a table of host, path and verdict, at most max_labelled rows of each verdict."""
    some = [labelled.where(F.col("verdict") == v).select("host", "path", "verdict").orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled) for v in ("allow", "block")]
    rows = sorted(tuple(r) for r in some[0].unionAll(some[1]).collect())
    return fit([r[0] for r in rows], [r[1] for r in rows], np.array([float(r[2] == "block") for r in rows]))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of each page.

    labelled (host, path, verdict) trains the model; by default it is the table
    of those pages that a rule decides.
    """
    ship(pages.sparkSession)
    parts = with_rule(pages.select("page_id", host_of().alias("host"), path_of().alias("path")), rules)
    model = train(parts.where("ruled is not null").select("host", "path", F.col("ruled").alias("verdict")) if labelled is None else labelled)

    @F.pandas_udf(DoubleType())
    def p_block(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(_logits(hosts.tolist(), paths.tolist(), model), -40, 40))))

    scored = parts.withColumn("p_block", p_block("host", "path"))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
