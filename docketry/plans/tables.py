"""Input tables and the record view that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries as records in loading order; nulls become empty text at this boundary."""
    empty = F.lit("")
    return table(spark, sf_dir, "patent_utility_info").select(
        F.col("rec_id").alias("ord"),
        F.coalesce("inventionTitle", empty).alias("title"),
        F.coalesce("applicationNumber", empty).alias("application_number"),
        F.coalesce("applicantName", empty).alias("applicant"),
        F.coalesce("ipcNumber", empty).alias("ipc"),
        F.coalesce("registerStatus", empty).alias("register_status"),
        F.coalesce("astrtCont", empty).alias("abstract"),
    )


RECORDS_SQL = """records AS (
  SELECT rec_id AS ord, coalesce("inventionTitle", '') AS title,
    coalesce("applicationNumber", '') AS application_number, coalesce("applicantName", '') AS applicant,
    coalesce("ipcNumber", '') AS ipc, coalesce("registerStatus", '') AS register_status,
    coalesce("astrtCont", '') AS abstract
  FROM patent_utility_info)"""
