"""Full history of changing attributes with the period in which each version was valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import digits_key, squeeze
from docketry.session import materialize

#: Length in seconds of the time slices into which the history of one key is cut for ordering.
SLICE_SECONDS = 7 * 86_400

READABLE_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"


def instant(col: Column) -> Column:
    """Timestamp of ISO text with an offset; text without one is taken as UTC; else null."""
    text = F.trim(col.cast("string"))
    known = F.when(text.rlike(READABLE_TIME), F.upper(text))
    zoned = F.when(known.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), known).otherwise(F.concat(known, F.lit("Z")))
    return F.try_to_timestamp(F.replace(F.replace(zoned, F.lit(" ")), F.lit(","), F.lit(".")))


def _sliced(df: DataFrame, at: str) -> DataFrame:
    """Add the time slice of each row."""
    return df.withColumn("slice", F.floor(F.unix_seconds(at) / F.lit(SLICE_SECONDS)))


def _numbered(df: DataFrame, at: str) -> DataFrame:
    """Add ``n``, the 1-based position of each row in its key, ordered by ``at`` (unique in a key).

    Rows are numbered inside (key, time slice) and shifted by the rows of the key's earlier slices,
    so no task holds the whole history of a hot key; only the counts per slice are gathered by key.
    """
    sliced = _sliced(df, at)
    counts = sliced.groupBy("key", "slice").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("key", "slice").orderBy(at)
    return (
        sliced.withColumn("i", F.row_number().over(inside))
        .join(offsets, ["key", "slice"])
        .withColumn("n", F.col("i") + F.col("skip"))
        .drop("i", "skip")
    )


def _lead_by_slice(df: DataFrame, at: str, name: str) -> DataFrame:
    """``lead(at)`` of the key's rows: inside the slice, else the first value of the next slice."""
    sliced = _sliced(df, at)
    firsts = sliced.groupBy("key", "slice").agg(F.min(at).alias("first"))
    following = firsts.select(
        "key", "slice", F.lead("first").over(Window.partitionBy("key").orderBy("slice")).alias("after")
    )
    inside = F.lead(at).over(Window.partitionBy("key", "slice").orderBy(at))
    return (
        sliced.withColumn("inside", inside)
        .join(following, ["key", "slice"])
        .withColumn(name, F.coalesce("inside", "after"))
        .drop("inside", "after", "slice")
    )


def change_events(
    entries: DataFrame,
    fields: tuple[str, ...],
    key: str = "applicationNumber",
    time: str = "decisionTime",
    order: str = "ord",
    normalise_key=digits_key,
    clean=squeeze,
    read_time=instant,
) -> DataFrame:
    """Differences between each entry of a key and the one before it.

    Result: ``key``, ``at`` (timestamp; null for ``deleted``), ``event`` (``inserted``, ``changed``,
    ``deleted``) and the cleaned fields. The k-th entries of all keys form the k-th snapshot;
    consecutive snapshots meet in a full outer join on (key, k) with null-safe comparison: only on the
    right is inserted, on both sides and different is changed, only on the left is deleted. A log
    doesn't say that an application ceased, so ``deleted`` marks the end of what is known of a key: there
    is one per key, behind its last entry. The comparison is by a 128-bit digest of the values, so
    strings that aren't asked for go no further than the table of usable entries. Of entries at one instant the lowest ``order`` holds;
    of rows equal in that too the least values hold. Rows with a null key or time are left out.
    """
    values = F.struct(*[clean(F.col(f)).alias(f) for f in fields])
    usable = entries.select(
        normalise_key(F.col(key)).alias("key"),
        read_time(F.col(time)).alias("at"),
        F.col(order).alias("o"),
        values.alias("values"),
    ).filter("key is not null and at is not null")
    one = usable.groupBy("key", "at").agg(
        F.min_by("values", F.struct(F.col("o").isNull(), "o", "values")).alias("values")
    )
    one = one.withColumn("digest", F.unhex(F.md5(F.to_json("values", {"ignoreNullFields": "false"}))))
    # Numbers, both sides of the join and the slices are made from it; written, it is read and reduced once.
    one = materialize(one, "entries")
    numbered = _numbered(one, "at").select("key", "n", "at", "digest", "values")
    previous = numbered.select("key", (F.col("n") + 1).alias("n"), F.col("digest").alias("old"), F.lit(True).alias("had"))
    both = numbered.withColumn("has", F.lit(True)).join(previous, ["key", "n"], "full_outer")
    event = (
        F.when(F.col("had").isNull(), "inserted")
        .when(F.col("has").isNull(), "deleted")
        .when(~F.col("digest").eqNullSafe(F.col("old")), "changed")
    )
    return (
        both.withColumn("event", event)
        .filter("event is not null")
        .select("key", "at", "event", *[F.col(f"values.{f}").alias(f) for f in fields])
    )


def versions(
    entries: DataFrame,
    fields: tuple[str, ...] = (
        "registerStatusAtDecision", "applicantNameAtDecision", "ipcNumberAtDecision",
    ),
    **options,
) -> DataFrame:
    """Every version of the fields with its period.

    Result: ``application_number``, ``valid_from``, ``valid_to`` (epoch seconds; 0 while the version is
    the last one) and the cleaned fields (null and blank are the empty string). A version is a longest run of entries
    with the same values; a value that comes back is a new version. See :func:`change_events` for
    ties, nulls and unusable rows; an empty table gives no rows. Other columns are ignored.

    Histories are ordered by time slices of :data:`SLICE_SECONDS`, so a key with a third of all
    entries is spread over as many tasks as it has slices.
    """
    events = change_events(entries, fields, **options)
    begun = events.filter("event <> 'deleted'").drop("event")
    return _lead_by_slice(begun, "at", "until").select(
        F.col("key").alias("application_number"),
        F.unix_seconds("at").alias("valid_from"),
        F.coalesce(F.unix_seconds("until"), F.lit(0).cast("long")).alias("valid_to"),
        *fields,
    )
