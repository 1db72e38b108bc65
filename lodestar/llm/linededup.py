"""Line dedup over all documents by a deletion-neighbourhood join.

Every line that isn't blank is judged (stretches between line breaks, ends
trimmed). An occurrence goes if an earlier one, by (doc_id, text, position),
has the same line, or, for lines of at least `near_words` words (stretches
between single spaces), one within one word inserted, deleted or replaced. The
earliest stays. Shorter lines are judged for equality only: one word is over a
tenth of them, and with it they say something else.

Variants of a line are the line without one of its words, and the line itself.
Two lines are within one edit exactly if they agree without the word at the
same place (replaced), or if one without a word is the other. So each variant
key is joined with its earliest line only: it lies within one edit of every
other line of the key, and lines are never paired off among themselves. The
edit is verified on the words.

Variants would be as many as words. Two lines within one edit share their
first or their last k words, for any k up to half the shorter line, so only
lines that share such an end with another line emit variants, and only of
words outside the shared end; nothing is lost.
Keys of variants come from prefixes of xor-ed word hashes, in a time linear in
the line, however long; a line's words are made where the line is and never
shuffled.

Only DataFrame operations run here. Counts and minima are combined before the
shuffle; a very common line is one row per partition there, and the join back
to its occurrences is one that Spark splits when skewed.

Defined results: null text has no lines, stays null and gives n_lines 0; null
ids come first; an empty table gives no rows; rows of one doc_id and one text
count as one document and get the same result; all other columns are passed on
as they are, whatever their names. Only columns n_lines and n_removed of docs
give way to those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import forget, stored

NEAR_WORDS = 10
_KEY = ["h1", "h2"]
_VARIANTS = "array<struct<key:bigint,role:int,at:int>>"


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: doc, text_hash, place, line, n (words) and its 128-bit key."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split("text", "\n")).alias("place", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line <> ''")
    return rows.withColumns({"n": F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1, "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def line_table(docs: DataFrame, near_words: int) -> DataFrame:
    """The judged lines without their texts, stored: doc, text_hash, place, key and, for lines to be compared, ends."""
    rows = _lines(docs).withColumn("ends", F.when(F.col("n") >= near_words, _ends()))
    return stored(rows.select("doc", "text_hash", "place", *_KEY, "ends"), "lines")


def _ends() -> Column:
    """Hashes of the first and the last k words; both k where a line one word shorter has another."""

    def both(n: Column) -> list[Column]:
        k = (4 * F.floor(n / 8)).cast("int")
        return [F.xxhash64(F.lit(1), k, F.call_function("substring_index", F.col("line"), F.lit(" "), k)), F.xxhash64(F.lit(2), k, F.call_function("substring_index", F.col("line"), F.lit(" "), -k))]

    own, shorter = both(F.col("n")), both(F.col("n") - 1)
    return F.when(F.col("n") % 8 == 0, F.array(*own, *shorter)).otherwise(F.array(*own))


def _without(words: str, place: str) -> Column:
    """The words without that at place; all of them for a null place."""
    cut = F.concat(F.slice(words, 1, F.col(place)), F.slice(words, F.col(place) + 2, F.size(words)))
    return F.when(F.col(place).isNull(), F.col(words)).otherwise(cut)


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Keys of the lines that have an earlier line within one edit (but not an equal one).

    lines is the stored table of all judged lines; only candidates' texts are
    fetched again from docs, each from its first occurrence.
    """
    ends = lines.where("ends is not null").select(*_KEY, "doc", "text_hash", "place", F.posexplode("ends").alias("side", "end"))
    shared = ends.groupBy("end").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("end")
    shared = stored(shared, "shared-ends")
    first = F.struct("doc", "text_hash", "place")
    chosen = ends.join(shared, "end", "left_semi").groupBy(*_KEY).agg(F.min(first).alias("first"), *(F.max(F.col("side") % 2 == n).alias(side) for n, side in enumerate(("by_first", "by_last"))))
    chosen = stored(chosen, "near-candidates")
    forget(shared)
    places = chosen.groupBy(F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("first.place", *_KEY, "by_first", "by_last")).alias("wanted"))
    sources = docs.select(F.col("doc_id").alias("of_doc"), F.xxhash64("text").alias("of_hash"), "text")
    found = sources.join(places, F.col("of_doc").eqNullSafe(F.col("doc")) & (F.col("of_hash") == F.col("text_hash")))
    found = found.select("doc", "text_hash", F.split("text", "\n").alias("split"), F.explode("wanted").alias("w"))
    found = found.select("w.h1", "w.h2", "w.by_first", "w.by_last", F.struct("doc", "text_hash", "w.place").alias("first"), F.btrim(F.get("split", F.col("w.place")), F.lit(" \t\r")).alias("line"))
    some = stored(found.groupBy(*_KEY).agg(F.min("first").alias("first"), F.first("line").alias("line"), F.first("by_first").alias("by_first"), F.first("by_last").alias("by_last")), "near-lines")
    forget(chosen)

    # the lines are dealt by key, and so are the rows of their words: one sort, no shuffle of words
    xor = lambda a, x: a.bitwiseXOR(x)
    zero = F.lit(0).cast("long")
    by_line = some.select(*_KEY, "by_first", "by_last", "line").repartition(*_KEY).withColumn("words", F.split("line", " ")).withColumn("n", F.size("words"))
    by_line = by_line.withColumns({"here": F.transform("words", lambda w, i: F.xxhash64(w, i)), "left": F.transform("words", lambda w, i: F.xxhash64(w, i - 1))})
    by_line = by_line.withColumns({"whole": F.aggregate("here", zero, xor), "all_left": F.aggregate("left", zero, xor)})
    words = by_line.select(*_KEY, "by_first", "by_last", "n", "whole", "all_left", F.posexplode_outer(F.arrays_zip("here", "left")).alias("i", "w"))
    before = Window.partitionBy(*_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = words.select(*_KEY, "by_first", "by_last", "n", "whole", "i", F.col("w.here").alias("here"), F.bit_xor("w.here").over(before).alias("upto"), F.col("all_left").bitwiseXOR(F.bit_xor("w.left").over(before)).alias("rest"))
    replaced = F.struct(F.xxhash64(F.lit("replaced"), "n", "i", F.col("whole").bitwiseXOR(F.col("here"))).alias("key"), F.lit(0).alias("role"), F.col("i").alias("at"))
    deleted = F.struct(F.xxhash64(F.lit("whole"), F.col("n") - 1, F.col("upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("rest"))).alias("key"), F.lit(1).alias("role"), F.col("i").alias("at"))
    itself = F.struct(F.xxhash64(F.lit("whole"), "n", "whole").alias("key"), F.lit(2).alias("role"), F.lit(None).cast("int").alias("at"))
    # the edit lies behind the first words that two lines share, or before the last ones
    k = 4 * F.floor((F.col("n") - 1) / 8)
    inside = (F.col("by_first") & (F.col("i") >= k)) | (F.col("by_last") & (F.col("i") < F.col("n") - k))
    own = F.when(F.col("i") == 0, F.array(itself)).otherwise(F.array().cast(_VARIANTS))
    emitted = words.select("h1", F.explode_outer(F.concat(F.when(inside, F.array(replaced, deleted)).otherwise(F.array().cast(_VARIANTS)), own)).alias("v"))
    emitted = emitted.where("v is not null").select("v.*", "h1")  # narrow: a line's number only

    keys = emitted.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    keys = stored(keys, "shared-variants")
    members = emitted.join(keys, "key", "left_semi").join(some.select(*_KEY, "first"), "h1")
    members = stored(members, "variant-members")
    forget(keys)
    hub = F.struct("first", "h1", "h2", "at")
    of_role = lambda r: F.min(F.when(F.col("role") == r, hub))
    hubs = members.groupBy("key").agg(*(of_role(r).alias(f"hub{r}") for r in range(3)))
    pairs = members.join(hubs, "key").withColumn("hub", F.when(F.col("role") == 0, F.col("hub0")).when(F.col("role") == 1, F.col("hub2")).otherwise(F.col("hub1")))
    pairs = pairs.where("hub.first < first").select(*_KEY, "at", F.col("hub.h1").alias("hub_h1"), F.col("hub.h2").alias("hub_h2"), F.col("hub.at").alias("hub_at"))
    texts = some.select(*_KEY, F.split("line", " ").alias("words"))
    pairs = pairs.join(texts, _KEY).join(texts.withColumnsRenamed({"h1": "hub_h1", "h2": "hub_h2", "words": "hub_words"}), ["hub_h1", "hub_h2"])
    near = stored(pairs.where(_without("words", "at") == _without("hub_words", "hub_at")).select(*_KEY).distinct(), "near-later")
    forget(some, members)
    return near


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with the text's later copies of lines removed, and n_lines and n_removed of each document."""
    lines = line_table(docs, near_words)
    first = F.struct("doc", "text_hash", "place")
    near = near_lines(docs, lines)
    repeated = lines.groupBy(*_KEY).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY, "first")
    judged = repeated.join(near.withColumn("later", F.lit(True)), _KEY, "full")
    judged = stored(judged.select(*_KEY, F.when(F.col("later").isNull(), F.col("first")).alias("keep")), "judged-lines")
    gone = lines.select(*_KEY, "doc", "text_hash", "place").join(judged, _KEY)
    gone = gone.where(F.col("keep").isNull() | ~F.struct("doc", "text_hash", "place").eqNullSafe(F.col("keep")))
    gone = gone.select("doc", "text_hash", "place").distinct().groupBy("doc", "text_hash").agg(F.collect_list("place").alias("places"))
    gone = stored(gone, "gone-lines")
    forget(lines, near, judged)

    passed = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in passed)).alias("row"))  # its own names can't clash inside
    out = row.join(gone, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("text_hash")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(left)
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in passed]
    counts = [F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*columns, *counts)
