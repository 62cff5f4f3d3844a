"""Several classification codes packed into one field: infer delimiters, split, explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import text_or_empty

#: Candidate delimiters: name, pattern in the text, pattern in the shape (the text with § for each code).
#: A list number such as ``2)`` opens a piece; blanks are only looked at beside a code.
CANDIDATES = (
    ("semicolon", ";", ";"),
    ("bar", r"\|", r"\|"),
    ("comma", ",", ","),
    ("line", r"[\r\n]+", r"[\r\n]+"),
    ("dot", "·", "·"),
    ("slash", "／", "／"),
    ("list number", r"(?:^|\s)\d{1,2}\)", r"(?:^|\s)\d{1,2}\)"),
    (
        "blank",
        # Before a subclass; behind a whole code; behind a subclass that no group follows.
        r"(?<=[^\s;|,·／)])[ \t]+(?=[A-HY]\d{2}[A-Z])|(?<=/[ \t]?\d{2,6}|\d{10})[ \t]+(?=[^\s;|,·／])(?!\d{1,2}\))"
        r"|(?<=[A-HY]\d{2}[A-Z])[ \t]+(?=[^\s\d\-;|,·／]|-$|-[ \t]+[A-HY]\d{2}[A-Z])",
        r"(?<=§)[ \t]+(?=[^\s;|,·／])(?!\d{1,2}\))|(?<=[^\s;|,·／)])[ \t]+(?=§)",
    ),
)
#: Marks that are dropped around a value and around a piece.
OUTER = r"^(?:[\s;|,·／]|\d{1,2}\)\s)+|[\s;|,·／]+$"
#: A candidate is a delimiter where at least this share of the pieces are codes or place-holders...
MIN_REGULAR = 0.5
#: ... and it cuts at least this share of the values that hold it into more than one piece with content.
MIN_CONSISTENT = 0.5

_SUBCLASS = r"[A-HY]\d{2}[A-Z]"
_GROUP = r"\d{1,4}\s*/\s*\d{2,6}"
#: A padded 14-character code, a subclass with or without a group, or a group alone.
CODE = rf"{_SUBCLASS}\d{{10}}|{_SUBCLASS}[\s\-]*{_GROUP}|{_SUBCLASS}|(?<![\d/]){_GROUP}"


def bare(col: Column) -> Column:
    """Upper case without remarks in parentheses, quotes, brackets and marks at both ends."""
    text = F.upper(text_or_empty(col))
    text = F.regexp_replace(text, r"\([^()]*\)", " ")
    text = F.regexp_replace(text, r"\([^()]*$", " ")
    return F.regexp_replace(F.regexp_replace(text, r"[\"'“”‘’\[\]{}]", ""), OUTER, "")


def layout(text: Column) -> Column:
    """Names of the candidates that occur in a value, joined by ``+``: values of one layout are inferred together."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p, _ in CANDIDATES])), "+")


def _cut(text: Column, patterns: list[str]) -> Column:
    """Trimmed pieces with content."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "\u0001")
    return F.filter(F.transform(F.split(text, "\u0001"), lambda p: F.regexp_replace(p, OUTER, "")), lambda p: p != "")


def delimiter_scores(df: DataFrame, value: str = "ipcNumber", source: str = "source") -> DataFrame:
    """Per source, layout and candidate: ``n_values``, ``consistency``, ``regularity``, ``gain``, ``accepted``.

    A layout is the set of candidates that occur in a value, so a feed that packs its codes in several
    ways is inferred way by way. ``consistency`` is the share of the values that the candidate alone
    cuts into two or more pieces with content. ``regularity`` is the share of the pieces, cut at all
    candidates of the layout, that are of a known type: one code, or a place-holder (no digit, no code).
    ``gain`` is how many more pieces are one code than if this candidate were left out: what only
    decorates gains nothing. A null source is a source of its own; blank and null values and values
    without any candidate score nothing; an empty table gives no rows.

    Values are first reduced to their shape, each code one sign, and equal shapes are counted where
    they are, so the scores are worked out over few short strings.
    """
    base = df.select(F.col(source).alias("source"), bare(F.col(value)).alias("text")).select("source", layout(F.col("text")).alias("layout"), "text").filter("layout <> ''")
    shape = F.regexp_replace("text", CODE, "§")
    shapes = base.groupBy("source", "layout", shape.alias("shape")).agg(F.count("*").alias("n"))

    def codes(pieces: Column) -> Column:
        return F.size(F.filter(pieces, lambda p: p == "§"))

    every = _cut(F.col("shape"), [p for _, _, p in CANDIDATES])
    counted = shapes.withColumns({"pieces": F.size(every), "codes": codes(every), "typed": F.size(F.filter(every, lambda p: (p == "§") | ~p.rlike(r"[\d§]")))})
    stats = [
        F.when(
            F.array_contains(F.split("layout", r"\+"), name),
            F.struct(
                F.lit(name).alias("delimiter"),
                (F.size(_cut(F.col("shape"), [pattern])) > 1).alias("cuts"),
                codes(_cut(F.col("shape"), [p for m, _, p in CANDIDATES if m != name])).alias("without"),
            ),
        )
        for name, _, pattern in CANDIDATES
    ]
    long = counted.select("source", "layout", "n", "pieces", "codes", "typed", F.explode(F.array_compact(F.array(*stats))).alias("s"))
    n = F.col("n")
    scored = long.groupBy("source", "layout", F.col("s.delimiter").alias("delimiter")).agg(
        F.sum(n).alias("n_values"),
        (F.sum(F.when(F.col("s.cuts"), n).otherwise(0)) / F.sum(n)).alias("consistency"),
        (F.sum(n * F.col("typed")) / F.greatest(F.sum(n * F.col("pieces")), F.lit(1))).alias("regularity"),
        F.sum(n * (F.col("codes") - F.col("s.without"))).alias("gain"),
    )
    return scored.withColumn(
        "accepted", (F.col("consistency") >= MIN_CONSISTENT) & (F.col("regularity") >= MIN_REGULAR) & (F.col("gain") > 0)
    )


def _written(code: Column) -> Column:
    """A code token as ``H01M 10/613``, ``H01M`` or, without subclass, `` 10/613``."""
    compact = F.regexp_replace(code, r"[\s\-]", "")
    padded = compact.rlike(rf"^{_SUBCLASS}\d{{10}}$")
    subclass = F.when(compact.rlike(rf"^{_SUBCLASS}"), F.substring(compact, 1, 4)).otherwise(F.lit(""))
    group = F.regexp_extract(compact, r"(\d+)/\d+$", 1)
    subgroup = F.regexp_extract(compact, r"/(\d+)$", 1)
    long_group = F.regexp_replace(F.substring(compact, 5, 4), "^0{1,3}", "")
    long_subgroup = F.regexp_replace(F.substring(compact, 9, 6), "^(..+?)0*$", "$1")
    return (
        F.when(padded, F.concat(subclass, F.lit(" "), long_group, F.lit("/"), long_subgroup))
        .when(group != "", F.concat(subclass, F.lit(" "), group, F.lit("/"), subgroup))
        .otherwise(subclass)
    )


def unpack_codes(
    df: DataFrame, id_col: str = "rec_id", value: str = "ipcNumber", source: str = "source"
) -> DataFrame:
    """One row per code: ``rec_id``, ``pos`` (from 1 in written order), ``ipc_code``.

    The delimiters accepted for a value's source and layout (:func:`delimiter_scores`) cut it into
    pieces, and a piece is one code or gives no row. A group without a subclass takes that of the code
    before it; without any before it, it is no code. Remarks, place-holders, blank and null values
    give no rows; repeated codes and repeated rows are kept. Other columns are ignored.

    All work but the scores is inside one scan without a shuffle; the scores hold one row per source
    and layout and are joined, as a broadcast when they are small.
    """
    accepted = (
        delimiter_scores(df, value, source)
        .filter("accepted")
        .groupBy(F.col("source").alias("s"), F.col("layout").alias("l"))
        .agg(F.collect_set("delimiter").alias("delimiters"))
    )
    base = df.select(F.col(id_col).alias("rec_id"), F.col(source).alias("src"), bare(F.col(value)).alias("text")).filter(
        "text <> ''"
    )
    base = base.withColumn("layout", layout(F.col("text")))
    joined = base.join(accepted, F.col("src").eqNullSafe(F.col("s")) & (F.col("layout") == F.col("l")), "left")
    cut = F.col("text")
    for name, pattern, _ in CANDIDATES:
        cut = F.when(F.array_contains("delimiters", name), F.regexp_replace(cut, pattern, "\u0001")).otherwise(cut)
    pieces = F.transform(F.split(cut, "\u0001"), lambda p: F.regexp_replace(p, OUTER, ""))
    tokens = F.filter(pieces, lambda p: p.rlike(f"^(?:{CODE})$"))
    start = F.struct(F.lit("").alias("sub"), F.array().cast("array<string>").alias("codes"))

    def step(acc: Column, code: Column) -> Column:
        sub = F.when(F.substring(code, 1, 1) == " ", acc["sub"]).otherwise(F.substring(code, 1, 4))
        full = F.when(F.substring(code, 1, 1) == " ", F.concat(acc["sub"], code)).otherwise(code)
        return F.struct(
            sub.alias("sub"),
            F.when(sub == "", acc["codes"]).otherwise(F.concat(acc["codes"], F.array(full))).alias("codes"),
        )

    codes = F.aggregate(F.transform(tokens, _written), start, step, lambda acc: acc["codes"])
    return (
        joined.select("rec_id", F.posexplode(codes).alias("p", "ipc_code"))
        .select("rec_id", (F.col("p") + 1).cast("int").alias("pos"), "ipc_code")
    )
