"""Connected components of a link table, by alternating star contractions.

Defined results: links with a null end and links of a node with itself are no
links; repeated links count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.llm.common import forget, stored


def _ends(*pairs: tuple[str, str]) -> Column:
    """The pairs of columns as rows (a, b), one below the other."""
    return F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))).alias("link")


def _large(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least of itself and its neighbours.

    The least neighbour is a map-side aggregate; neighbours are never gathered.
    """
    both = links.select(_ends(("a", "b"), ("b", "a"))).select("link.*")
    least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("low")).withColumn("low", F.least("of", "low"))
    hung = both.where("b > a").join(least, F.col("a") == F.col("of"))
    return hung.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of these; in links, a is the larger end."""
    least = links.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("low"))
    hung = links.join(least, F.col("a") == F.col("of"))
    return hung.select(_ends(("a", "low"), ("b", "low"))).select("link.*").where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the least node of its component.

    Each round is written to the shared folder: a lost executor costs at most
    one round. What tells that nothing changed (a count and a hash of the
    links) is observed while a round is written. The rounds grow with the
    logarithm of the links.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("mark")), "links")
        return out, (seen.get["n"], seen.get["mark"])

    now, last = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not last[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        earlier, (now, seen) = now, written(_small(_large(now)))
        forget(earlier)
        if seen == last:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        last = seen
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
