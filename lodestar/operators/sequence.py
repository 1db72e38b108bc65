"""Order within a document: neighbours, context windows, heading groups, lookups, paging and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(chunks: DataFrame, doc: str = "doc_id", ord_: str = "ord", key: str = "chunk_id") -> DataFrame:
    """chunks with prev_id and next_id within the document."""
    along = Window.partitionBy(doc).orderBy(ord_, key)
    return chunks.withColumns({"prev_id": F.lag(key).over(along), "next_id": F.lead(key).over(along)})


def context_text(chunks: DataFrame, prev: int = 1, next_: int = 1, doc: str = "doc_id", ord_: str = "ord", text: str = "text", key: str = "chunk_id") -> DataFrame:
    """chunks with context: prev texts before, its own and next_ texts after, joined by line breaks."""
    frame = Window.partitionBy(doc).orderBy(ord_, key).rowsBetween(-prev, next_)
    return chunks.withColumn("context", F.array_join(F.collect_list(text).over(frame), "\n"))


def heading_groups(blocks: DataFrame, starts: Column, doc: str = "doc_id", ord_: str = "ord") -> DataFrame:
    """blocks with group: how many starts there are up to each block."""
    along = Window.partitionBy(doc).orderBy(ord_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(along))


def cut_levels(blocks: DataFrame) -> DataFrame:
    """(doc_id, chapter, section): the first two heading levels that occur twice or more."""
    counts = blocks.where("kind = 'heading' and heading_level between 1 and 9").groupBy("doc_id", "heading_level").count().where("count >= 2")
    levels = counts.groupBy("doc_id").agg(F.sort_array(F.collect_list("heading_level")).alias("levels"))  # at most 9 a document
    return levels.select("doc_id", F.get("levels", F.lit(0)).alias("chapter"), F.get("levels", F.lit(1)).alias("section"))


def cut_groups(blocks: DataFrame) -> DataFrame:
    """blocks with group, cut at both levels, but not between a chapter heading and a section that follows at once."""
    along = Window.partitionBy("doc_id").orderBy("ord")
    known = blocks.join(cut_levels(blocks).withColumnRenamed("doc_id", "of_doc"), F.col("doc_id") == F.col("of_doc"), "left").drop("of_doc")
    is_heading = F.col("kind") == "heading"
    is_chapter = F.coalesce(is_heading & (F.col("heading_level") == F.col("chapter")), F.lit(False))
    is_section = F.coalesce(is_heading & (F.col("heading_level") == F.col("section")), F.lit(False))
    known = known.withColumns({"_chapter": is_chapter, "_section": is_section})
    starts = F.col("_chapter") | (F.col("_section") & ~F.coalesce(F.lag("_chapter").over(along), F.lit(False)))
    return heading_groups(known.withColumn("_starts", starts), F.col("_starts")).drop("_chapter", "_section", "_starts", "chapter", "section")


def lookup(chunks: DataFrame, ids: list[str], key: str = "chunk_id") -> DataFrame:
    """Rows of the ids in the order asked for; unknown ids are skipped, repeated ones count once."""
    spark = chunks.sparkSession
    wanted = spark.createDataFrame([(i, p) for p, i in enumerate(dict.fromkeys(ids))], "_id string, _place int")
    return chunks.join(F.broadcast(wanted), F.col(key) == F.col("_id")).orderBy("_place").drop("_id", "_place")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


#: result keys of a file list and the value that a null counts as
FILE_SORTS = {
    "file": ("source_uri", ""), "size": ("file_size_bytes", 0), "pages": ("page_count", 0), "chunks": ("chunk_count", 0),
    "updated": ("updated_at_meta", ""), "author": ("author_guess", ""), "inserted": ("extracted_at", ""),
}


def sort_files(files: DataFrame, by: str = "default", descending: bool = False) -> DataFrame:
    """Files by one of FILE_SORTS, ties by doc_id; the default order is always ascending by doc_id."""
    if by not in FILE_SORTS:
        return files.orderBy("doc_id")
    column, null = FILE_SORTS[by]
    value = F.coalesce(F.lower(column) if by in ("file", "author") else F.col(column), F.lit(null))
    return files.orderBy(value.desc() if descending else value.asc(), "doc_id")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; equal versions are told apart by nothing and one stays."""
    along = Window.partitionBy(key).orderBy(F.col(version).desc())
    return df.withColumn("_n", F.row_number().over(along)).where("_n = 1").drop("_n")


def orphans(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files without chunks."""
    return files.join(chunks.select("doc_id"), "doc_id", "left_anti")


def unregistered(scanned: DataFrame, known: DataFrame, content: str = "content") -> DataFrame:
    """Scanned rows (size, content) whose size and SHA-256 no known row (size, sha256) has.

    Contents are hashed where they are read, so only sizes and hashes are
    joined; contents move only if what follows keeps them.
    """
    hashed = scanned.withColumn("_sha256", F.sha2(content, 256))
    registered = known.select(F.col("size").alias("_size"), F.col("sha256").alias("_known")).distinct()
    return hashed.join(registered, (F.col("size") == F.col("_size")) & (F.col("_sha256") == F.col("_known")), "left_anti").drop("_sha256")


def delete_report(matching: DataFrame, batch: int = 1000) -> DataFrame:
    """One row: how many rows a delete takes, and in how many batches."""
    n = F.count(F.lit(1))
    return matching.agg(n.alias("total_ids"), n.alias("db_deleted"), F.ceil(n / batch).cast("long").alias("batches"))
