"""Benchmark decontamination by winnowing.

Fingerprints of a text are the least hash of every `SPAN - GRAM + 1` following
GRAM-word grams. A shared run of SPAN words holds one whole such window, so
both sides keep the same least hash: every shared run of SPAN words or more is
found. Documents that share a fingerprint with the benchmark get their matches
extended: each SPAN-word window around a matching gram is looked up among the
benchmark's windows, word for word. Benchmark items of fewer than SPAN words
are one window each and are looked up at every place, for the few lengths that
occur, in one pass.

Only DataFrame operations run here. Computed arrays are exploded by
explode_outer(): for explode() Catalyst infers a filter on the array's size
that repeats the whole expression, inlined into its own lambdas. Fingerprints join the benchmark's distinct
ones and windows its distinct ones, so a passage that a third of all documents
share gives one row per place where it occurs, whatever number of items hold
it. Spark broadcasts the benchmark only if its stored size allows; else both
joins are shuffled, with skewed partitions split.

Defined results: null text has no words; an empty benchmark hits nothing; null
item_ids are not counted; rows of one doc_id are rows of their own, told apart
by their text; repeated rows repeat their result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, UPPER, stored

SPAN, GRAM = 10, 5
GROUPS = 128
_GAPS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def words_of(text: str = "text") -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    plain = F.translate(F.col(text), UPPER + _GAPS, LOWER + " " * len(_GAPS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def with_grams(df: DataFrame, gram: int = GRAM) -> DataFrame:
    """df (with words) plus n_words and grams: the hash of the gram that starts at each word."""
    hashed = df.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.slice("hashes", 1, F.greatest(F.lit(0), F.size("hashes") - (gram - 1)))
    grams = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get("hashes", i + j) for j in range(1, gram))))
    return hashed.withColumn("grams", grams).drop("hashes")


def with_fingerprints(df: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """df (with grams) plus prints: the distinct least hashes of the windows of span words."""
    window = span - gram + 1
    least = lambda a, b: F.least(a, b)
    low, width, out = F.col("grams"), 1, df.withColumn("low1", F.col("grams"))
    while width < window:  # minima of twice the width each time, the last step by what is left
        step = min(width, window - width)
        tail = F.slice(f"low{width}", step + 1, F.greatest(F.lit(0), F.size(f"low{width}") - step))
        out = out.withColumn(f"low{width + step}", F.zip_with(F.slice(f"low{width}", 1, F.greatest(F.lit(0), F.size(f"low{width}") - step)), tail, least))
        width += step
    low = F.array_distinct(f"low{window}")
    return out.withColumn("prints", low).select(*df.columns, "prints")


def _short_windows(widths: list[int]) -> Column:
    """Every run of as many words of a text, with its start and width."""

    def of(width: int) -> Column:
        places = F.sequence(F.lit(0), F.size("words") - width)
        runs = F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(width).alias("width"), F.array_join(F.slice("words", i + 1, width), " ").alias("window")))
        return F.when(F.size("words") >= width, runs).otherwise(F.array().cast("array<struct<start:int,width:int,window:string>>"))

    return F.flatten(F.array(*(of(width) for width in widths)))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, width, window) of every distinct window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")).where("item_id is not null and size(words) > 0")
    width = F.least(F.size("words"), F.lit(span))
    places = F.sequence(F.lit(0), F.size("words") - width)
    windows = F.transform(places, lambda i: F.array_join(F.slice("words", i + 1, width), " "))
    return items.select("item_id", width.alias("width"), F.explode_outer(windows).alias("window")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, keyed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document; keyed: with text_hash, xxhash64(text), too."""
    of_items = stored(benchmark_windows(benchmark, span), "item-windows")
    windows = stored(of_items.select("width", "window").distinct(), "windows")
    items = benchmark.select(words_of().alias("words")).where(F.size("words") >= span)
    bench = stored(with_fingerprints(with_grams(items, gram), span, gram).select(F.explode_outer("prints").alias("print")).where("print is not null").distinct(), "bench-prints")
    short = sorted(r["width"] for r in windows.where(F.col("width") < span).select("width").distinct().collect())  # at most span - 1 numbers

    keyed_docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    fingerprinted = with_fingerprints(with_grams(keyed_docs.withColumn("words", words_of()), gram), span, gram)
    all_docs = stored(fingerprinted.select("doc_id", "text_hash", "n_words", "prints"), "doc-prints")

    key = ["doc_id", "text_hash"]
    prints = all_docs.where(F.size("prints") > 0).select(*key, F.explode("prints").alias("print"))
    # matches in groups by remainder, so that a text that copies much of the benchmark is not searched once a gram and match
    group = lambda x: F.pmod(x, F.lit(GROUPS).cast("long")).cast("int")
    matching = prints.join(bench, "print").groupBy(*key, group(F.col("print")).alias("group")).agg(F.collect_set("print").alias("some"))
    matching = matching.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("group", "some"))).alias("matches"))
    matching = matching.withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_hash"})
    found = keyed_docs.join(matching, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")))
    found = with_grams(found.dropDuplicates(key).withColumn("words", words_of()), gram)
    reach = span - gram
    near = F.transform("grams", lambda x, i: F.when(F.coalesce(F.array_contains(F.try_element_at("matches", group(x)), x), F.lit(False)), F.sequence(F.greatest(F.lit(0), i - reach), i)).otherwise(F.array().cast("array<int>")))
    found = found.select(*key, "words", F.array_distinct(F.flatten(near)).alias("starts"))
    found = found.select(*key, "words", F.explode_outer("starts").alias("start")).where(F.col("start") + span <= F.size("words"))
    runs = found.select(*key, "start", F.lit(span).alias("width"), F.array_join(F.slice("words", F.col("start") + 1, span), " ").alias("window"))
    if short:
        some = keyed_docs.dropDuplicates(key).withColumn("words", words_of()).select(*key, F.explode_outer(_short_windows(short)).alias("at")).where("at is not null")
        runs = runs.unionAll(some.select(*key, "at.start", "at.width", "at.window"))
    hits = stored(runs.join(windows, ["width", "window"]), "hits")

    earlier = Window.partitionBy(*key).orderBy("start", "width").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("width")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0))))
    n_hit = hits.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(*key, "width", "window").distinct().join(of_items, ["width", "window"]).select(*key, "item_id").distinct()
    named = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    verdicts = n_hit.join(named, (n_hit.doc_id.eqNullSafe(named.doc_id)) & (n_hit.text_hash == named.text_hash)).select(
        n_hit.doc_id.alias("of_doc"), n_hit.text_hash.alias("of_hash"), "n_hit", "n_items", "items_sha256"
    )
    out = all_docs.select(*key, "n_words").join(verdicts, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")
    return out.select(
        *(key if keyed else ["doc_id"]), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
