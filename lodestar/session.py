"""Session defaults that the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # decode() of Shift_JIS and windows-1252
}


def get_session(app: str = "lodestar", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Sets the defaults on a session made elsewhere."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


SPLIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is so small that its scan may be a single row group; larger inputs are split by their scan.

    For work that costs far more than moving its rows, on at most SPLIT_BYTES
    for each core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
