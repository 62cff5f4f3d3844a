"""Append-only decision log as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_entries(spark: SparkSession, entries: DataFrame, path: str) -> None:
    """Append decision entries; earlier files are never rewritten.

    ``ord`` continues from the highest number stored and keeps the order of ``entries``. Two appends at the same moment may share numbers, but none is lost; readers break such
    ties by the remaining values.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    last = 0
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        last = spark.read.parquet(path).agg(F.max("ord")).first()[0] or 0
    # The ids are increasing but not dense across partitions; a log needs order only.
    number = (F.monotonically_increasing_id() + F.lit(last + 1)).alias("ord")
    entries.select(number, *entries.columns).write.mode("append").parquet(path)
