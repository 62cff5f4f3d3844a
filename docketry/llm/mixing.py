"""Mixing sources to target weights with capped repetition (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.tokens import VOCABULARY, count_tokens
from docketry.session import materialize

#: Documents of a source are dealt into this many buckets by their seeded hash.
BUCKETS = 4096
#: A plan is a hand-written table; one with more sources than this is refused.
MAX_SOURCES = 100_000


def water_fill(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: in proportion to the shares, none above its cap, ``total`` in all.

    Sources that would exceed their cap are clamped to it, and what they can't give is spread over
    the others in proportion, until no source exceeds its cap. If all caps together fall short of
    ``total``, every source with a share gives its cap.
    """
    give = {s: 0.0 for s in shares}
    free = {s for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    left = float(total)
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        over = {s for s in free if shares[s] / weight * left >= caps[s]}
        if not over:
            give.update({s: shares[s] / weight * left for s in free})
            break
        for s in over:
            give[s] = float(caps[s])
        left -= sum(give[s] for s in over)
        free -= over
    return give


def _clean_plan(plan: DataFrame) -> list:
    rows = plan.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("The plan has too many sources.")
    names = [r.source for r in rows if r.source is not None]
    if len(set(names)) < len(names):
        raise ValueError("The plan names a source twice.")
    return [r for r in rows if r.source is not None]


def mix(
    documents: DataFrame, plan: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """Uses per document, and shares per source.

    The first result has ``doc_id``, ``source``, ``n_tokens``, ``uses`` for every document of a planned source;
    the second ``source``, ``target_share``, ``available_tokens``, ``max_repeats``, ``epochs``, ``used_tokens``,
    ``actual_share``, ``is_capped`` for every source of the plan, those without documents included.

    ``total_tokens`` is by default what the planned sources have, counted once. :func:`water_fill` gives the
    tokens of each source; divided by what it has they are its epochs. A document is used once per
    whole epoch, and once more if it is drawn for the fractional one: documents are ordered by a
    seeded hash and drawn until the fraction is reached, so that the source exceeds its tokens by
    nothing and misses them by less than one document. No document exceeds ``max_repeats``, as epochs
    don't. Null texts have 0 tokens; documents with a null or unplanned source are left out; rows
    with the same ``doc_id`` are drawn separately; null shares and repeats count as 0; empty tables give
    uses without rows and shares of 0. Other columns are ignored.

    Texts are tokenized once and only the counts are written. Drawing needs sums of 4,096 buckets per
    source, combined before their shuffle, and one bucket's documents in order.
    """
    spark = documents.sparkSession
    rows = _clean_plan(plan)
    names = spark.createDataFrame([(r.source,) for r in rows], "source string")
    salt = F.xxhash64(F.lit(seed), F.col("doc_id"))
    counted = materialize(
        documents.select("doc_id", "source", "text")
        .join(F.broadcast(names), "source")
        .select("doc_id", "source", count_tokens(F.col("text"), vocabulary).alias("n_tokens"))
        .withColumn("draw", salt)
        .withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int")),
        "token-counts",
    )
    sums = materialize(counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "bucket-sums")
    has = {r.source: r.tokens for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = {r.source: float(r.target_share or 0) for r in rows}
    caps = {r.source: float(has.get(r.source, 0) * max(0, r.max_repeats or 0)) for r in rows}
    give = water_fill(shares, caps, sum(has.values()) if total_tokens is None else total_tokens)
    epochs = {s: give[s] / has[s] if has.get(s) else 0.0 for s in give}
    allotted = spark.createDataFrame(
        [
            (r.source, shares[r.source], int(has.get(r.source, 0)), int(r.max_repeats or 0), epochs[r.source],
             int(epochs[r.source] + 1e-9), max(0.0, give[r.source] - int(epochs[r.source] + 1e-9) * has.get(r.source, 0)),
             give[r.source] > 0 and give[r.source] >= caps[r.source])
            for r in rows
        ],
        "source string, target_share double, available_tokens long, max_repeats int, epochs double, whole int, wanted double, is_capped boolean",
    )
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    before = sums.withColumn("before", running - F.col("tokens"))
    # Per bucket: what the buckets before it leave to draw from it; all of it if that is enough.
    room = before.join(F.broadcast(allotted.select("source", "whole", "wanted")), "source").select(
        "source", "bucket", "whole", (F.col("wanted") - F.col("before")).alias("room"), "tokens"
    )
    edge = room.filter("room > 0 and room < tokens").select("source", "bucket", "room")
    full = room.select("source", "bucket", "whole", (F.col("room") >= F.col("tokens")).alias("drawn"))
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id")
    at_edge = (
        counted.join(F.broadcast(edge), ["source", "bucket"])
        .withColumn("sofar", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("sofar <= room and n_tokens > 0")
        .groupBy("source", "bucket", "draw", "doc_id")
        .agg(F.count("*").alias("extra"))
    )
    joined = counted.join(full, ["source", "bucket"]).join(at_edge, ["source", "bucket", "draw", "doc_id"], "left")
    # Rows with the same doc_id share the draw: each takes part in order, so numbering settles which.
    nth = F.row_number().over(Window.partitionBy("source", "bucket", "draw", "doc_id").orderBy("n_tokens"))
    uses = joined.withColumn("nth", nth).select(
        "doc_id", "source", "n_tokens",
        (F.col("whole") + (F.col("drawn") | (F.col("nth") <= F.coalesce("extra", F.lit(0)))).cast("int")).alias("uses"),
    )
    used = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"))
    whole = Window.partitionBy()
    report = (
        allotted.join(used, "source", "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        .withColumn("all_tokens", F.sum("used_tokens").over(whole))
        .select(
            "source", "target_share", "available_tokens", "max_repeats", "epochs", "used_tokens",
            F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
            "is_capped",
        )
    )
    return uses, report
