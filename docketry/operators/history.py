"""Decision log: history per application, latest decision, comparison with current records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import config as C
from docketry.functions.text import or_dash, squeeze, text_or_empty

ENTRY_FIELDS = (
    "applicationNumber", "inventionTitle", "decision", "decisionReason", "decisionTime",
    "registerStatusAtDecision", "applicantNameAtDecision", "ipcNumberAtDecision",
    "relevanceScoreAtDecision", "reviewPriorityAtDecision",
)
# Stored field, current field, display name; compared in this order.
COMPARED = (
    ("registerStatusAtDecision", "register_status", "등록상태"),
    ("applicantNameAtDecision", "applicant", "출원인"),
    ("ipcNumberAtDecision", "ipc", "IPC"),
)

#: Characters of the decision time that make a slice: a day.
SLICE_CHARS = 10
#: Entries in one list of a history.
PAGE = 1000


def keyed(log: DataFrame) -> DataFrame:
    """Entries with a non-empty application number; others can never be matched."""
    return log.filter(text_or_empty(F.col("applicationNumber")) != "")


def history_sizes(log: DataFrame) -> DataFrame:
    """Entries per application, a combined count that needs no list per key."""
    return keyed(log).groupBy("applicationNumber").agg(F.count("*").alias("n_entries"))


def latest_entries(log: DataFrame) -> DataFrame:
    """The entry with the greatest ``decisionTime`` text per application; the first appended wins ties.

    A partial aggregate (argmax), so a key with very many entries is reduced before the shuffle.
    Missing times sort first. Of entries that share time and ``ord``, the one with the greatest
    values holds, compared field by field.
    """
    value = F.struct(*[F.col(c) for c in ("ord", *ENTRY_FIELDS[1:])])
    by = F.struct(text_or_empty(F.col("decisionTime")).alias("t"), (-F.col("ord")).alias("o"), value.alias("v"))
    return (
        keyed(log)
        .groupBy("applicationNumber")
        .agg(F.max_by(value, by).alias("__e"), F.count("*").alias("n_entries"))
        .select("applicationNumber", "__e.*", "n_entries")
    )


def history_listing(log: DataFrame) -> DataFrame:
    """Every entry with its ``position`` in its application's history, newest first.

    Entries are numbered inside (application, first characters of the time) and shifted by the
    entries of later slices, so the history of a hot application is spread over tasks. Missing times
    come last; entries that share time and ``ord`` are ordered by their values.
    """
    time = text_or_empty(F.col("decisionTime"))
    slices = keyed(log).withColumn("__slice", F.left(time, F.lit(SLICE_CHARS)))
    counts = slices.groupBy("applicationNumber", "__slice").agg(F.count("*").alias("__n"))
    later = Window.partitionBy("applicationNumber").orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("applicationNumber", "__slice", F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__skip"))
    values = [F.col(c) for c in ENTRY_FIELDS[1:] if c != "decisionTime"]
    inside = Window.partitionBy("applicationNumber", "__slice").orderBy(time.desc(), F.col("ord").asc(), *values)
    return (
        slices.withColumn("__i", F.row_number().over(inside))
        .join(offsets, ["applicationNumber", "__slice"])
        .select(*log.columns, (F.col("__i") + F.col("__skip")).alias("position"))
    )


def history_pages(log: DataFrame, size: int = PAGE) -> DataFrame:
    """The entries of each application as lists, newest first, in pages of at most ``size`` entries.

    Result: ``applicationNumber``, ``page`` (from 1) and ``entries``, an array of structs (``position``
    and the stored fields). Pages keep a list bounded however many entries an application has; one of
    up to ``size`` entries has its whole history in one row. Entries without a number give no page.
    """
    entry = F.struct("position", *ENTRY_FIELDS[1:])
    return (
        history_listing(log)
        .groupBy("applicationNumber", ((F.col("position") - 1) / size).cast("long").alias("__p"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select("applicationNumber", (F.col("__p") + 1).alias("page"), "entries")
    )


def _match_key(number: Column) -> Column:
    """Join key: blank and null numbers match nothing, so each gets a place of its own instead of one hot one."""
    return F.when(text_or_empty(number) == "", F.concat(F.lit("\0"), F.monotonically_increasing_id())).otherwise(number)


def with_history(records: DataFrame, log: DataFrame, size: int = PAGE) -> DataFrame:
    """Records with every page of their application's decisions (:func:`history_pages`).

    Records without history stay, with null ``page`` and ``entries``.
    """
    pages = history_pages(log, size).withColumnRenamed("applicationNumber", "__number")
    keyed_records = records.withColumn("__key", _match_key(F.col("application_number")))
    return keyed_records.join(pages, F.col("__key") == F.col("__number"), "left").drop("__key", "__number")


def differences(entry: Column | None = None) -> Column:
    """Array of (field, previous, current) for the compared fields that differ as cleaned text."""
    def previous(name: str) -> Column:
        return squeeze(entry.getField(name) if entry is not None else F.col(name))

    items = F.array(
        *[
            F.struct(
                F.lit(label).alias("field"),
                previous(stored).alias("previous"),
                squeeze(F.col(current)).alias("current"),
            )
            for stored, current, label in COMPARED
        ]
    )
    return F.filter(items, lambda x: x["previous"] != x["current"])


def compare_with_latest(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records with their latest decision, the differences to it and the review state.

    A left join on the application number: records without history stay, empty numbers match
    nothing and are spread over all tasks. The log is reduced to one row per application first; AQE
    broadcasts it if it is small and splits the records of a hot application if it isn't.
    """
    latest = latest_entries(log).select(
        F.col("applicationNumber").alias("__key"),
        F.struct("decision", "decisionTime", *[s for s, _, _ in COMPARED]).alias("__latest"),
        F.col("n_entries").alias("__n"),
    )
    asked = records.withColumn("__asked", _match_key(F.col("application_number")))
    joined = asked.join(latest, F.col("__asked") == F.col("__key"), "left").drop("__asked")
    seen = F.col("__key").isNotNull()
    diffs = F.when(seen, differences(F.col("__latest"))).otherwise(
        F.array().cast("array<struct<field:string,previous:string,current:string>>")
    )
    out = joined.withColumn("differences", diffs)
    return out.withColumns(
        {
            "latest_decision": F.col("__latest.decision"),
            "latest_time": F.col("__latest.decisionTime"),
            "n_entries": F.coalesce(F.col("__n"), F.lit(0)),
            "review_state": F.when(~seen, C.STATE_NONE)
            .when(F.size("differences") > 0, C.STATE_CHANGED)
            .otherwise(C.STATE_SAME),
        }
    ).drop("__key", "__latest", "__n")


def displayed_differences(compared: DataFrame, key: str = "application_number") -> DataFrame:
    """:func:`changed_fields` as they are shown: a value that wasn't stored has a text of its own."""
    shown = {c: or_dash(F.col(c), C.EMPTY_SNAPSHOT) for c in ("previous", "current")}
    return changed_fields(compared, key).withColumns(shown)


def displayed(records: DataFrame) -> DataFrame:
    """Records as they are shown: a title text for untitled ones, a dash for any other empty field."""
    fields = ("application_number", "applicant", "ipc", "register_status", "abstract", "matched_concepts", "score_reason")
    dashes = {f: or_dash(F.col(f)) for f in fields if f in records.columns}
    return records.withColumns({"title": or_dash(F.col("title"), C.UNTITLED), **dashes})


def changed_fields(compared: DataFrame, key: str = "application_number") -> DataFrame:
    """Long form of the differences: one row per changed field."""
    return compared.select(key, F.explode("differences").alias("__d")).select(key, "__d.*")


def reviewed(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records with at least one decision."""
    keys = keyed(log).select(F.col("applicationNumber").alias("application_number")).distinct()
    return records.join(keys, "application_number", "left_semi")


def unreviewed(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records without any decision, those without a number included."""
    keys = keyed(log).select(F.col("applicationNumber").alias("application_number")).distinct()
    return records.join(keys, "application_number", "left_anti")


def decision_entries(records: DataFrame, decision: str, reason: str, at: Column | None = None) -> DataFrame:
    """Snapshots of scored records to append to the log.

    ``decision`` must be one of the review choices. ``at`` is the decision time as text; by default
    the session's present time with offset, in whole seconds.
    """
    if decision not in C.REVIEW_CHOICES:
        raise ValueError(f"decision must be one of {C.REVIEW_CHOICES}.")
    at = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")
    return records.select(
        text_or_empty(F.col("application_number")).alias("applicationNumber"),
        text_or_empty(F.col("title")).alias("inventionTitle"),
        F.lit(decision).alias("decision"),
        F.lit((reason or "").strip()).alias("decisionReason"),
        at.alias("decisionTime"),
        text_or_empty(F.col("register_status")).alias("registerStatusAtDecision"),
        text_or_empty(F.col("applicant")).alias("applicantNameAtDecision"),
        text_or_empty(F.col("ipc")).alias("ipcNumberAtDecision"),
        F.coalesce(F.col("relevance_score").cast("double"), F.lit(0.0)).alias("relevanceScoreAtDecision"),
        text_or_empty(F.col("review_priority")).alias("reviewPriorityAtDecision"),
    )
