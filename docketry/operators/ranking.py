"""Ranking, top-k, rank numbers and band summary of scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import config as C


def ranked(df: DataFrame, order: str = "ord") -> DataFrame:
    """Score descending; ties keep the source order given by ``order``. A range-partitioned sort."""
    return df.orderBy(F.col("relevance_score").desc_nulls_last(), F.col(order).asc())


def top(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` of :func:`ranked`, planned as a distributed top-k without a full sort."""
    if n < 1:
        raise ValueError("n must be positive.")
    return ranked(df, order).limit(n)


def with_rank(df: DataFrame, order: str = "ord", name: str = "rank") -> DataFrame:
    """Add the 1-based position in the ranking without sorting everything in one task.

    Rows are numbered inside their score value and shifted by the number of rows with a higher
    score. Inside a score, rows are numbered by blocks of 65,536 source numbers, so that a score
    shared by most rows is spread over many tasks. The offsets are made in two levels: over scores,
    of which there are at most 1,001 (one decimal in 0 to 100), and over the blocks inside each score.
    ``order`` must be an integer column; ties in it are broken by nothing and should not occur. A null
    score ranks last; an empty table gives no rows.
    """
    from pyspark.sql import Window

    block = F.shiftright(F.col(order).cast("long"), 16)
    base = df.withColumns({"__score": F.coalesce(F.col("relevance_score"), F.lit(-1.0)), "__block": block})
    counts = base.groupBy("__score", "__block").agg(F.count("*").alias("__n"))

    def earlier(window: Window) -> Column:
        return F.coalesce(F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    scores = counts.groupBy("__score").agg(F.sum("__n").alias("__n"))
    higher = scores.select("__score", earlier(Window.orderBy(F.col("__score").desc())).alias("__higher"))
    inside = Window.partitionBy("__score").orderBy(F.col("__block").asc_nulls_first())
    before = (
        counts.select("__score", "__block", earlier(inside).alias("__same"))
        .join(higher, "__score")
        .select("__score", "__block", (F.col("__higher") + F.col("__same")).alias("__before"))
    )
    local = F.row_number().over(Window.partitionBy("__score", "__block").orderBy(F.col(order).asc()))
    return (
        base.withColumn("__local", local)
        .alias("a")
        .join(
            before.alias("b"),
            F.col("a.__score").eqNullSafe(F.col("b.__score"))
            & F.col("a.__block").eqNullSafe(F.col("b.__block")),
        )
        .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("__local") + F.col("__before")).alias(name))
    )


def band_summary(df: DataFrame) -> DataFrame:
    """One row: all rows and rows per band, zero where a band is empty, in a single pass."""
    p = F.col("review_priority")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(p == C.PRIORITY_HIGH).alias("high"),
        F.count_if(p == C.PRIORITY_MEDIUM).alias("medium"),
        F.count_if(p == C.PRIORITY_LOW).alias("low"),
    )
