"""Column expressions for text: folding, white space, phrases, masking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus the four separators that Java's class leaves out.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def text_or_empty(col: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def squeeze(col: Column) -> Column:
    """White-space runs become one blank, outer white space goes, null becomes empty."""
    return F.trim(F.regexp_replace(text_or_empty(col), SPACE_RUN, " "))


def without_space(col: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text_or_empty(col), SPACE_RUN, "")


def edge_trim(col: Column) -> Column:
    """Unicode white space removed at both ends only."""
    return F.regexp_replace(
        text_or_empty(col), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""
    )


def folded(col: Column) -> Column:
    """Lower case for matching. Differs from full case folding for characters such as ß."""
    return F.lower(text_or_empty(col))


def has_phrase(folded_text: Column, phrase: str) -> Column:
    """Literal, case-folded substring test; ``folded_text`` is already folded."""
    return F.contains(folded_text, F.lit(phrase.casefold()))


def has_any_phrase(folded_text: Column, phrases: tuple[str, ...]) -> Column:
    """Any of the phrases occurs. No phrase at all gives false."""
    return reduce(lambda a, b: a | b, [has_phrase(folded_text, p) for p in phrases], F.lit(False))


def or_dash(col: Column, default: str = "-") -> Column:
    """Display value: the default where the text is null or empty."""
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(default))


# Fixed value: what counts as a key parameter and its value.
SECRET_PATTERN = r"(?i)(accessKey|serviceKey)(\s*[=:]\s*)[^&\s<>\"']+"


def mask_secrets(col: Column, secret: str = "") -> Column:
    """Replace a known secret and every key parameter's value by ``[REDACTED]``."""
    masked = F.replace(col, F.lit(secret), F.lit("[REDACTED]")) if secret else col
    return F.regexp_replace(masked, SECRET_PATTERN, "$1$2[REDACTED]")


def mask_text(text: str, secret: str = "", mark: str = "[REDACTED]") -> str:
    """Driver-side form of :func:`mask_secrets` for messages."""
    if secret:
        text = text.replace(secret, mark)
    return re.sub(SECRET_PATTERN, rf"\1\2{mark}", text)


def digits_key(col: Column, length: int = 13) -> Column:
    """A number compared by its digits alone; null unless it has ``length`` digits."""
    digits = F.regexp_replace(col.cast("string"), r"[^0-9]", "")
    return F.when(F.length(digits) == length, digits)
