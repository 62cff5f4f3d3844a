"""Classification-code signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import without_space


def compact_codes(col: Column) -> Column:
    """Upper case without any white space, the form the family test looks at."""
    return without_space(F.upper(col))


def has_family(compact: Column, code: str) -> Column:
    """The family stands alone: nothing alphanumeric before it, a digit, slash or the end behind.

    White space is gone already, so a family written after another code and a blank is not found;
    that is the published behaviour.
    """
    # Fixed value: the pattern of a family.
    return compact.rlike(rf"(?<![A-Z0-9]){code}(?=\p{{Nd}}|/|$)")
