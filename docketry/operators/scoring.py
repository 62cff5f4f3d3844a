"""Scoring of records against a technology phrase, as pure column expressions.

The phrase is a scalar of the query, so the target groups, the keywords and the mode are decided on
the driver; the plan holds only the expressions that the phrase needs. A record has the columns
``title``, ``abstract`` and ``ipc`` (strings); nulls count as empty text. Further columns are kept;
columns named like an assessment column are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import config as C
from docketry.functions.ipc import compact_codes, has_family
from docketry.functions.keywords import keywords, targets
from docketry.functions.text import folded, has_any_phrase, has_phrase


def band(score: Column, cfg: C.ScoringConfig | None = None) -> Column:
    """Review band of a score; null and NaN are low."""
    cfg = cfg or C.ScoringConfig()
    usable = F.nanvl(score.cast("double"), F.lit(None).cast("double"))
    return (
        F.when(usable >= cfg.high_min, C.PRIORITY_HIGH)
        .when(usable >= cfg.medium_min, C.PRIORITY_MEDIUM)
        .otherwise(C.PRIORITY_LOW)
    )


def badge(priority: Column) -> Column:
    """Coloured mark and label of a band; unknown labels get the neutral mark."""
    marks = F.create_map(*[F.lit(x) for pair in C.PRIORITY_BADGES.items() for x in pair])
    mark = F.coalesce(F.try_element_at(marks, priority), F.lit(C.PRIORITY_BADGE_DEFAULT))
    return F.concat(mark, F.lit(" "), F.coalesce(priority, F.lit("")))


def _points(flag: Column, weight: float) -> Column:
    return F.when(flag, F.lit(weight)).otherwise(F.lit(0))


def _total(parts: list[Column]) -> Column:
    out = F.lit(0)
    for part in parts:
        out = out + part
    return out


def _joined(separator: str, parts: list[Column], default: str = "") -> Column:
    """Join the parts that are not null; the default if there is none."""
    if not parts:
        return F.lit(default)
    text = F.concat_ws(separator, *parts)
    return F.when(text == "", F.lit(default)).otherwise(text) if default else text


def _named(flags: list[tuple[Column, str]], separator: str, before: str, after: str) -> Column:
    """``before`` + the names of the true flags + ``after``; null if none is true."""
    any_true = F.lit(False)
    for flag, _ in flags:
        any_true = any_true | flag
    names = F.concat_ws(separator, *[F.when(flag, F.lit(name)) for flag, name in flags])
    return F.when(any_true, F.concat(F.lit(before), names, F.lit(after)))


def _texts(df: DataFrame) -> DataFrame:
    """Folded texts once per row, under names no input uses."""
    return df.withColumns(
        {
            "__title": folded(F.col("title")),
            "__abstract": folded(F.col("abstract")),
            "__ipc": compact_codes(F.col("ipc")),
        }
    )


def _finish(df: DataFrame, score: Column, matched: Column, reason: Column, mode: str, cfg) -> DataFrame:
    return (
        df.withColumns({"__score": score.cast("double"), "__matched": matched, "__reason": reason})
        .withColumns(
            {
                "relevance_score": F.col("__score"),
                "review_priority": band(F.col("__score"), cfg),
                "matched_concepts": F.col("__matched"),
                "score_reason": F.col("__reason"),
                "analysis_mode": F.lit(mode),
            }
        )
        .drop("__title", "__abstract", "__ipc", "__score", "__matched", "__reason")
    )


def concept_hits(df: DataFrame, technology: str, cfg: C.ScoringConfig | None = None) -> DataFrame:
    """Add ``hit_title_<g>``, ``hit_abstract_<g>`` per targeted group and ``hit_<code>`` per family."""
    cfg = cfg or C.ScoringConfig()
    wanted = targets(technology, cfg)
    out = _texts(df)
    flags = {}
    for group in wanted:
        flags[f"hit_title_{group}"] = has_any_phrase(F.col("__title"), cfg.groups[group])
        flags[f"hit_abstract_{group}"] = has_any_phrase(F.col("__abstract"), cfg.groups[group])
    for code, group in cfg.ipc_families:
        if group in wanted:
            flags[f"hit_{code}"] = has_family(F.col("__ipc"), code)
    return out.withColumns(flags).drop("__title", "__abstract", "__ipc") if flags else out.drop(
        "__title", "__abstract", "__ipc"
    )


def score_concepts(df: DataFrame, technology: str, cfg: C.ScoringConfig) -> DataFrame:
    """Weighted concept presence in title and abstract, core bonuses and code signals."""
    wanted = targets(technology, cfg)
    no = F.lit(False)
    title, abstract = F.col("__title"), F.col("__abstract")
    out = _texts(df)
    flags = {}
    for group in wanted:
        flags[f"__t_{group}"] = has_any_phrase(title, cfg.groups[group])
        flags[f"__a_{group}"] = has_any_phrase(abstract, cfg.groups[group])
    families = [(code, group) for code, group in cfg.ipc_families if group in wanted]
    for code, _ in families:
        flags[f"__f_{code}"] = has_family(F.col("__ipc"), code)
    out = out.withColumns(flags)

    in_title = {g: F.col(f"__t_{g}") if g in wanted else no for g in cfg.groups}
    in_abstract = {g: F.col(f"__a_{g}") if g in wanted else no for g in cfg.groups}
    found = {g: in_title[g] | in_abstract[g] for g in cfg.groups}
    battery, cooling, vehicle = (found.get(g, no) for g in ("battery", "cooling", "vehicle"))
    codes = [(F.col(f"__f_{code}"), code) for code, _ in families]

    parts = [_points(in_title[g], cfg.title_weights[g]) for g in wanted]
    parts += [_points(in_abstract[g], cfg.abstract_weights[g]) for g in wanted]
    parts.append(
        F.when(battery & cooling, F.lit(cfg.both_core_bonus))
        .when(battery | cooling, F.lit(cfg.single_core_bonus))
        .otherwise(F.lit(0))
    )
    parts.append(_points(vehicle, cfg.vehicle_bonus))
    parts += [_points(flag, cfg.ipc_bonus) for flag, _ in codes]
    score = F.least(_total(parts), F.lit(cfg.cap))

    matched = _joined(
        ";",
        [F.when(found[g], F.lit(g)) for g in cfg.groups]
        + [F.when(flag, F.lit(f"IPC:{code}")) for flag, code in codes],
    )
    name = cfg.names
    reason = _joined(
        ", ",
        [
            F.when(battery & cooling, F.lit("배터리·냉각 개념 모두 확인"))
            .when(battery, F.lit("배터리 개념 확인"))
            .when(cooling, F.lit("냉각 개념 확인")),
            F.when(vehicle, F.lit("차량 개념 확인")),
            _named([(in_title[g], name[g]) for g in cfg.groups], "·", "제목에서 ", " 발견"),
            _named([(in_abstract[g], name[g]) for g in cfg.groups], "·", "초록에서 ", " 발견"),
            _named(codes, "/", "", " IPC 확인"),
        ],
        C.NO_CONCEPT_REASON,
    )
    scored = _finish(out, score, matched, reason, C.MODE_CONCEPT, cfg)
    return scored.drop(*flags)


def score_keywords(df: DataFrame, technology: str, cfg: C.ScoringConfig) -> DataFrame:
    """Fallback: literal keywords of the phrase, relative to the best score reachable."""
    words = keywords(technology, cfg)
    out = _texts(df)
    if not words:
        return _finish(
            out, F.lit(0.0), F.lit(""), F.lit(C.NO_KEYWORD_REASON), C.MODE_GENERIC, cfg
        )
    flags = {}
    for i, word in enumerate(words):
        flags[f"__t_{i}"] = has_phrase(F.col("__title"), word)
        flags[f"__a_{i}"] = has_phrase(F.col("__abstract"), word)
    for code, _ in cfg.ipc_families:
        flags[f"__f_{code}"] = has_family(F.col("__ipc"), code)
    out = out.withColumns(flags)
    t = [(F.col(f"__t_{i}"), w) for i, w in enumerate(words)]
    a = [(F.col(f"__a_{i}"), w) for i, w in enumerate(words)]
    codes = [(F.col(f"__f_{code}"), code) for code, _ in cfg.ipc_families]

    several = _total([_points(x | y, 1) for (x, _), (y, _) in zip(t, a)]) >= 2
    points = _total(
        [_points(flag, cfg.generic_title_weight) for flag, _ in t]
        + [_points(flag, cfg.generic_abstract_weight) for flag, _ in a]
        + [_points(several, cfg.generic_multi_bonus)]
        + [_points(flag, cfg.generic_ipc_weight) for flag, _ in codes]
    )
    best = len(words) * (cfg.generic_title_weight + cfg.generic_abstract_weight)
    best += (cfg.generic_multi_bonus if len(words) > 1 else 0)
    best += cfg.generic_ipc_weight * len(codes)
    score = F.round(F.lit(100.0) * points / F.lit(float(best)), 1)
    # Title hits first, then what only the abstract has, both in keyword order.
    matched = _joined(
        ";",
        [F.when(x, F.lit(w)) for x, w in t] + [F.when(y & ~x, F.lit(w)) for (x, w), (y, _) in zip(t, a)],
    )
    reason = _joined(
        ", ",
        [
            _named(t, "·", "제목 키워드: ", ""),
            _named(a, "·", "초록 키워드: ", ""),
            F.when(several, F.lit(f"복수 키워드 동시 발견 (+{cfg.generic_multi_bonus}점)")),
            _named(codes, "/", "IPC 보조 확인: ", ""),
        ],
        C.NO_HIT_REASON,
    )
    return _finish(out, score, matched, reason, C.MODE_GENERIC, cfg).drop(*flags)


def score_records(df: DataFrame, technology: str, cfg: C.ScoringConfig | None = None) -> DataFrame:
    """Add the five assessment columns. The mode depends on the phrase only."""
    cfg = cfg or C.ScoringConfig()
    if targets(technology, cfg):
        return score_concepts(df, technology, cfg)
    if cfg.fallback == "none":
        return _finish(
            _texts(df), F.lit(0.0), F.lit(""), F.lit(C.NO_GROUP_REASON), C.MODE_CONCEPT, cfg
        ).drop("analysis_mode")
    return score_keywords(df, technology, cfg)


def mode_notice(technology: str, cfg: C.ScoringConfig | None = None) -> str:
    """The message to show when the fallback was used, else the empty string."""
    cfg = cfg or C.ScoringConfig()
    return "" if targets(technology, cfg) or cfg.fallback == "none" else C.GENERIC_NOTICE
