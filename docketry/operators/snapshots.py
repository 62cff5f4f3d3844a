"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import digits_key, squeeze
from docketry.session import materialize


def _with_next(states: DataFrame, numbers: DataFrame) -> DataFrame:
    """Add ``first`` (is it the first snapshot) and ``next`` (number of the following one or null).

    The chain has a row per delivery and is written, so its size is known when the join is planned:
    Spark broadcasts it unless there are very many deliveries, and joins by number then, where no
    single delivery holds much of the table.
    """
    order = Window.orderBy("snapshot")
    chain = numbers.select(
        "snapshot", F.lag("snapshot").over(order).isNull().alias("first"), F.lead("snapshot").over(order).alias("next")
    )
    return states.join(materialize(chain, "snapshot-chain"), "snapshot")


def snapshot_changes(
    snapshots: DataFrame,
    fields: tuple[str, ...] = ("registerStatus", "applicantName"),
    key: str = "applicationNumber",
    snapshot: str = "snapshot_no",
    loaded: str = "loaded_at",
    normalise_key=digits_key,
    clean=squeeze,
) -> DataFrame:
    """Keys added, removed or changed between each snapshot and the one before it.

    Result: ``snapshot_no`` (the later of the two), ``application_number``, ``change_kind`` (``added``,
    ``removed``, ``changed``) and ``changed_fields`` (sorted names; empty for added and removed).

    Every state is unpivoted into cells (key, field, cleaned value) and a presence marker. In the
    comparison with the snapshot before it a state counts +1, in the one with the snapshot after it
    -1; what is left after summing is what changed. Rules: the row with the latest ``loaded`` holds,
    null being the earliest, and of rows equal in that the greatest values hold; rows whose key the
    normaliser rejects (null) or without a snapshot number are left out; a snapshot exists if any row
    carries its number; an empty table or a single snapshot gives no rows. Other columns are ignored.

    Shuffles: one combined aggregate to a row per snapshot and key, so that repeated rows of a hot
    key are reduced before it, and one by key alone, in which a key has at most one row a snapshot;
    the unpivot and both sums after it need no further exchange.
    """
    rows = snapshots.select(
        F.col(snapshot).cast("int").alias("snapshot"),
        normalise_key(F.col(key)).alias("key"),
        F.col(loaded).alias("loaded"),
        F.struct(*[clean(F.col(f)).alias(f"v{i}") for i, f in enumerate(fields)]).alias("values"),
    ).filter("snapshot is not null")
    numbers = snapshots.select(F.col(snapshot).cast("int").alias("snapshot")).filter("snapshot is not null").distinct()
    states = (
        rows.filter("key is not null")
        .groupBy("snapshot", "key")
        .agg(F.max_by("values", F.struct("loaded", "values")).alias("values"))
    )
    states = _with_next(states, numbers).repartition("key")

    def cells(at: Column, sign: int) -> list[Column]:
        cell = [("", F.lit(""))] + [(f, F.col(f"values.v{i}")) for i, f in enumerate(fields)]
        return [
            F.struct(at.alias("at"), F.lit(name).alias("field"), value.alias("value"), F.lit(sign).alias("sign"))
            for name, value in cell
        ]

    later = F.when(~F.col("first"), F.array(*cells(F.col("snapshot"), 1)))
    earlier = F.when(F.col("next").isNotNull(), F.array(*cells(F.col("next"), -1)))
    none = F.array().cast("array<struct<at:int,field:string,value:string,sign:int>>")
    signed = states.select(
        "key", F.explode(F.concat(F.coalesce(later, none), F.coalesce(earlier, none))).alias("c")
    ).select("key", "c.*")
    left = (
        signed.groupBy("key", "at", "field", "value").agg(F.sum("sign").alias("n")).filter("n <> 0")
    )
    presence = F.sum(F.when(F.col("field") == "", F.col("n")).otherwise(0))
    changed = F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field"))))
    summed = left.groupBy("key", "at").agg(presence.alias("presence"), changed.alias("names"))
    return summed.select(
        F.col("at").alias("snapshot_no"),
        F.col("key").alias("application_number"),
        F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed").alias(
            "change_kind"
        ),
        F.when(F.col("presence") == 0, F.col("names")).otherwise(F.array().cast("array<string>")).alias(
            "changed_fields"
        ),
    )
