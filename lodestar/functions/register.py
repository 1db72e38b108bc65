"""The engine's functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.operators.pdftext import normalise_page
from lodestar.operators.segment import SEGMENTS, SegmentParams, segment, text_blocks


def register(spark: SparkSession, params: SegmentParams = SegmentParams()) -> list[str]:
    """Registers ls_segments(text) and ls_normalise_page(text); their names."""

    @F.pandas_udf(SEGMENTS)
    def ls_segments(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("text", "page_start", "page_end"), s, strict=True)) for s in segment(text_blocks(t or ""), params)])

    @F.pandas_udf(StringType())
    def ls_normalise_page(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else normalise_page(p))

    spark.udf.register("ls_segments", ls_segments)
    spark.udf.register("ls_normalise_page", ls_normalise_page)
    return ["ls_segments", "ls_normalise_page"]
