"""Text that looks the same but differs in its characters: one form per look (problem 4)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.session import materialize

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅЗІЈКМНОРСТУХѴаеѕіјорсухѵԁԛԝһӏ", "ABES3IJKMHOPCTYXVaesijopcyxvdqwhl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
LOOK_ALIKES = CYRILLIC | GREEK

#: Blocks whose characters stand in for ordinary ones of the same look; their compatibility
#: decomposition is the ordinary form. Superscripts, fractions and circled signs look different.
STAND_IN_BLOCKS = (
    (0x2103, 0x2103), (0x2109, 0x2109), (0x2126, 0x2126), (0x212A, 0x212B), (0x2160, 0x217F),
    (0x3371, 0x33DF), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF),
)
SPACES = "  " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
#: Ranges of characters that can't be seen: controls but tab and line breaks, format characters,
#: fillers, variation selectors.
INVISIBLE = (
    "\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f­͏؜ᅟᅠ឴឵᠋-᠏"
    "​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻"
)
#: Conjoining Hangul parts and combining marks: what composition may change.
DECOMPOSED = "[̀-ͯᄀ-ᇿꥠ-꥿ힰ-퟿]"


def _stand_ins() -> tuple[dict[str, str], dict[str, str]]:
    """Stand-ins for one character and for several, by rule from the Unicode tables."""
    single, several = {"\u00b5": "\u03bc"}, {}
    for low, high in STAND_IN_BLOCKS:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain == c or c == "\uffa0" or plain in LOOK_ALIKES:
                continue
            if len(plain) == 1:
                single[c] = plain
            elif plain.isprintable():
                several[c] = plain
    for space in SPACES:
        single[space] = " "
    single["\u2011"] = "-"
    return single, several


SINGLE, SEVERAL = _stand_ins()
_LETTER = "A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u052f"
_LOOK = "".join(LOOK_ALIKES)
_EDGE = rf"(?<=[{_LETTER}])(?![{_LETTER}])|(?<![{_LETTER}])(?=[{_LETTER}])"
#: A run of letters is Latin in disguise if all of it is Latin or looks like it and it has a Latin letter. A run
#: without one is left alone: it is a symbol or a word of its own script, and nothing in it tells otherwise.
_DISGUISED = rf"^[{_LOOK}]*[A-Za-z][A-Za-z{_LOOK}]*$"


def _ranges(codes: list[int]) -> str:
    """A character class of the code points, written as ranges."""
    out, start = [], None
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{c:x}}}")
            start = None
    return "".join(out)


def _ordinary() -> str:
    """Class of characters no rule touches: what most texts consist of, found by the rules themselves."""
    # The pattern tries the ranges in turn, so the most frequent ones come first.
    blocks = [(0xAC00, 0xD7A3), (0x20, 0x7E), (0x4E00, 0x9FFF), (0x9, 0xD), (0xA1, 0x24F), (0x370, 0x3FF)]
    blocks += [(0x2010, 0x205E), (0x2190, 0x22FF), (0x3001, 0x303F), (0xFFFD, 0xFFFD)]
    touched = set(LOOK_ALIKES) | set(SINGLE) | set(SEVERAL)
    hidden = re.compile(f"[{INVISIBLE}]|{DECOMPOSED}")
    codes = [c for a, b in blocks for c in range(a, b + 1) if chr(c) not in touched and not hidden.match(chr(c))]
    return _ranges([c for c in codes if unicodedata.normalize("NFC", chr(c)) == chr(c)])


#: A value of such characters only is its own form; this one test settles most values. A possessive run is
#: read in one loop, which is faster than a search for any other character and needs no stack.
_ORDINARY_ONLY = rf"\A[{_ordinary()}]*+\z"
#: The same of few ranges that hold most text, tried first: Hangul, ASCII and the signs of usual units.
_MOSTLY = r"\A[\x{ac00}-\x{d7a3}\x20-\x7e\n\xb0\xc5\x{3b1}-\x{3bd}\x{3a9}]*+\z"


def unusual(col: Column) -> Column:
    """Does the value hold a character that some rule may touch?"""
    return ~col.rlike(_MOSTLY) & ~col.rlike(_ORDINARY_ONLY)


def mapped_form(col: Column) -> Column:
    """The value with invisible characters removed and look-alikes mapped; marks stay decomposed.

    Greek and Cyrillic letters are mapped only in runs of letters that are Latin in disguise, so
    symbols such as α, μm or kΩ and words of those languages stay, even where all their letters look Latin.
    """
    text = F.regexp_replace(col, f"[{INVISIBLE}]", "")
    text = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    pattern = "[" + "".join(SEVERAL) + "]"
    pieces = F.split(text, f"(?={pattern})|(?<={pattern})")
    table = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    text = F.when(text.rlike(pattern), spelled).otherwise(text)
    runs = F.transform(
        F.split(text, _EDGE),
        lambda r: F.when(r.rlike(_DISGUISED), F.translate(r, _LOOK, "".join(LOOK_ALIKES.values()))).otherwise(r),
    )
    return F.when(text.rlike(f"[{_LOOK}]"), F.array_join(runs, "")).otherwise(text)


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


_HIDDEN = re.compile(f"[{INVISIBLE}]")
_TABLE = str.maketrans(SINGLE | SEVERAL)
_RUN = re.compile(f"[{_LETTER}]+")
_IS_DISGUISED = re.compile(_DISGUISED)
_TO_LATIN = str.maketrans(LOOK_ALIKES)


def plain(text: str) -> str:
    """What :func:`mapped_form` and composition make of a text, outside SQL."""
    text = _HIDDEN.sub("", text).translate(_TABLE)
    text = _RUN.sub(lambda m: m.group().translate(_TO_LATIN) if _IS_DISGUISED.match(m.group()) else m.group(), text)
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(plain, na_action="ignore")


def plain_form(col: Column) -> Column:
    """:func:`plain` of the values with an unusual character; only these are sent to Python."""
    return F.coalesce(_plain(F.when(unusual(col), col)), col)


def composed(col: Column) -> Column:
    """Canonical composition. Only values with an unusual character are sent to Python; NFC leaves all others."""
    return F.coalesce(_composed(F.when(unusual(col), col)), col)


def uniform_text(
    df: DataFrame, fields: tuple[str, ...], id_col: str = "rec_id", only_odd: bool = False
) -> DataFrame:
    """One row per record and non-null field: ``rec_id``, ``field_name``, ``value``, ``canonical``, ``odd``.

    The mapped values (:func:`mapped_form`) are grouped under the accent-sensitive Unicode collation,
    which joins composed and decomposed writings. The canonical member of a class is the one with the
    fewest parts to compose, then the least by code point, and is returned composed. ``odd`` tells
    that the value needed it; ``only_odd`` returns just these rows. Null values give no rows, empty ones
    are their own form; repeated rows are kept; an empty table gives none. Other columns are ignored.

    A value without any unusual character is composed and has nothing mapped, so it is what its class
    composes to: its own canonical form, whatever else is in the class. One scan settles these; only
    values with an unusual character are mapped, grouped and joined. Sorting by collation is dear, so
    this matters most. Classes are combined before their shuffle: copies of one value, however many,
    cost a row per task.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    long = (
        df.select(F.col(id_col).alias("rec_id"), F.explode(cells).alias("c"))
        .select("rec_id", "c.*")
        .filter("value is not null")
    )
    odd_one = unusual(F.col("value"))
    suspects = materialize(
        long.filter(odd_one).withColumn("seen", mapped_form(F.col("value"))), "unusual-values"
    )
    spark = df.sparkSession
    classes = spark.sql(
        """SELECT seen COLLATE UNICODE AS look, min_by(seen, struct(parts, seen)) AS member
        FROM {values} GROUP BY seen COLLATE UNICODE""",
        values=suspects.groupBy("seen").agg(F.any_value(F.regexp_count("seen", F.lit(DECOMPOSED))).alias("parts")),
    ).withColumn("canonical", composed(F.col("member")))
    odd = spark.sql(
        """SELECT o.rec_id, o.field_name, o.value, c.canonical, o.value <> c.canonical AS odd
        FROM {values} o JOIN {classes} c ON o.seen COLLATE UNICODE = c.look""",
        values=suspects,
        classes=classes,
    )
    if only_odd:
        return odd.filter("odd")
    plain = long.filter(~odd_one).select(
        "rec_id", "field_name", "value", F.col("value").alias("canonical"), F.lit(False).alias("odd")
    )
    return odd.unionByName(plain)
