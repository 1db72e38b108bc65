"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of words. Blocks of `block_words` words are
the seats: sources win them by their highest quotients target / (2k + 1), and
within a source its shards (seeded groups of documents) win the source's seats
by shard_words / (2k + 1). A shard lays its documents end to end in a seeded
order, and its blocks are taken along that line, round and round where a shard
has won more blocks than it holds.

Only DataFrame operations run here. The per-word work is one projection; after
it only ids, sources and sizes move. Sources and shards are tables of their
own, made by map-side aggregation, and a hot source is spread over as many
shards as it needs, so no task holds a whole source. The table of sources (one
row of some hundred bytes each) is sorted in one task, as the water level and
the seats of sources are decided over all of them: sources are corpora or
sites by the thousand or the million, not one for each document.

Defined results: a null text has size 0; an empty table gives no rows; sources
are null-safe (null is the last source); repeated rows are rows of their own;
columns other than doc_id, text and source are ignored. Where all sizes are 0,
all targets and taken are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

BLOCK_WORDS = 64
DOCS_PER_SHARD = 2_000
MAX_REPEATS = 3
SEED = "mix-1"


def word_count(text: str = "text"):
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r."""
    spaced = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: str, key: str, votes: str, seats: str) -> DataFrame:
    """parties with a column won: seats of each group dealt to its keys by highest quotients.

    All seats but a few are decided by the natural divisor votes/seats: the
    final divisor moves no party by more than its share of half the number of
    parties. Only quotients in that margin are ranked, so the ranked rows grow
    with the parties and not with the seats. Ties go to the smaller key.
    """
    within = Window.partitionBy(group)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    near = (
        parties.withColumns({"_all": F.sum(votes).over(within), "_n": F.count(F.lit(1)).over(within)})
        .withColumn("_mid", F.floor(share * F.col(seats) + 0.5))
        .withColumn("_slack", F.ceil(share * F.col("_n") / 2) + 1)
        .withColumn("_low", F.greatest(F.lit(0), F.col("_mid") - F.col("_slack")))
        .withColumn("_left", F.col(seats) - F.sum("_low").over(within))
    )
    ranked = near.select(
        group, key, "_left", F.col(votes).alias("_votes"),
        F.explode(F.sequence("_low", F.col("_mid") + F.col("_slack"))).alias("_k"),
    ).where("_votes > 0")
    quotient = (F.col("_votes") / (2 * F.col("_k") + 1)).desc()
    won = (
        ranked.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(quotient, key, "_k")))
        .where("_place <= _left")
        .groupBy(F.col(group).alias("_g"), F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    out = near.join(won, (F.col(group) == F.col("_g")) & (F.col(key) == F.col("_key")), "left")
    more = F.when(F.col("_all") > 0, F.col("_low") + F.coalesce("_more", F.lit(0))).otherwise(F.lit(0))
    return out.withColumn("won", more.cast("long")).select(*parties.columns, "won")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: place, source_size, n_docs, weight and target.

    Weights 1, 2, 3 repeat along the sources by code point, null last. The
    water level: with sources by cap over weight, the first i stop at their
    caps and the rest share what is left; the level is the first one that the
    next source doesn't reach.
    """
    everything = Window.partitionBy(F.lit(0))  # one row per source, not per document
    by_room = everything.orderBy("room", "place").rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", (1 + F.col("place") % 3).cast("double"))
        .withColumn("cap", max_repeats * F.col("source_size").cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_room), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return sources.select("source", "place", "source_size", "n_docs", "weight", "total", target.alias("target"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each row."""
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    sources = source_targets(sizes, max_repeats).withColumns({
        "all_seats": F.floor(F.col("total") / block_words + 0.5), "one": F.lit(0),
        "n_shards": 1 + F.floor(F.col("n_docs") / docs_per_shard),
    })
    sources = sainte_lague(sources, "one", "place", "target", "all_seats")
    sources = stored(sources.select("source", "place", "source_size", "target", "n_shards", F.col("won").alias("seats")), "mix-sources")

    order = F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    spread = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    lines = (
        sizes.withColumn("order", order)
        .join(sources.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("shard", spread % F.col("n_shards"))
    )
    shards = lines.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shards = sainte_lague(shards, "place", "shard", "shard_size", "seats").select(
        F.col("place").alias("of_place"), F.col("shard").alias("of_shard"), "shard_size", (F.col("won") * block_words).alias("quota")
    )
    laid = lines.join(shards, (F.col("place") == F.col("of_place")) & (F.col("shard") == F.col("of_shard")))
    along = Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(along), F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0))
    rest = F.when(F.col("shard_size") > 0, F.col("quota") % F.col("shard_size")).otherwise(F.lit(0))
    once = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    taken = F.least(max_repeats * F.col("size"), F.col("rounds") * F.col("size") + once)
    return (
        laid.withColumns({"before": before, "rounds": rounds, "rest": rest})
        .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )
