"""Hybrid document search on Spark: readers, segmenter, text and vector search, fusion and a versioned store."""
