"""A decision log kept as one JSON array per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.history import ENTRY_FIELDS


def parse_log(files: DataFrame, value: str = "value") -> DataFrame:
    """Entries of JSON arrays with ``ord``, their place in the array.

    Elements that are no objects are dropped; missing fields are null. A text that is no JSON, or
    whose root is no array, fails the query, so that a damaged log is never taken for an empty one.
    """
    parsed = files.select(F.try_parse_json(F.col(value)).alias("__log"))
    is_array = F.coalesce(F.schema_of_variant("__log").startswith("ARRAY"), F.lit(False))
    checked = parsed.select(
        F.when(is_array, F.col("__log")).otherwise(
            F.raise_error(F.lit("The decision log is damaged: it must be a JSON array.")).cast("variant")
        ).alias("__log")
    )
    spark = files.sparkSession
    entries = spark.sql(
        "SELECT e.pos AS ord, e.value AS entry FROM {logs} t, LATERAL variant_explode(t.__log) e", logs=checked
    ).filter(F.schema_of_variant("entry").startswith("OBJECT"))
    types = {"relevanceScoreAtDecision": "double"}
    return entries.select(
        F.col("ord").cast("long").alias("ord"),
        *[F.try_variant_get("entry", f"$.{f}", types.get(f, "string")).alias(f) for f in ENTRY_FIELDS],
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the log at ``path``; a missing file is an empty log."""
    from pyspark.sql import types as T

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fields = [T.StructField("ord", T.LongType())] + [
            T.StructField(f, T.DoubleType() if f.startswith("relevance") else T.StringType()) for f in ENTRY_FIELDS
        ]
        return spark.createDataFrame([], T.StructType(fields))
    return parse_log(spark.read.text(path, wholetext=True))
