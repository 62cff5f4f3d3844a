"""Registered queries of the corpus operators, with the SQL that checks them where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.llm.leakage import leak_report, leaks
from docketry.llm.look_alikes import uniform_text
from docketry.llm.mixing import mix
from docketry.llm.names import name_classes, name_pairs
from docketry.llm.splitting import split_oversized
from docketry.llm.truncation import cut_shares, truncated
from docketry.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TEXT_FIELDS = ("inventionTitle", "astrtCont")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# Problem 4: visually identical text.

# Fixed values, by code point: stand-ins that occur in the tables and what they stand for.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace("'", "''")
_BLANKS = "       　"
_UNSEEN = "­᠎​‌‍‎‏⁠﻿"
_PAIRS = {"℃": "°C", "℉": "°F", "㎜": "mm", "㎝": "cm", "㎞": "km", "㎏": "kg", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "µ": "μ"}
_FOREIGN = "АВЕЅІЈКМНОРСТУХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
_LATIN = "ABESIJKMHOPCTYXaesijopcyxABEZHIKMNOPTYXo"
_LETTERS = "A-Za-zÀ-ɏͰ-ϿЀ-ԯ"


def _uniform_sql(col: str) -> str:
    x = f"translate(regexp_replace({col}, '[{_UNSEEN}]', '', 'g'), '{_WIDE}{_BLANKS}', '{_NARROW}{' ' * len(_BLANKS)}')"
    for sign, plain in _PAIRS.items():
        x = f"replace({x}, '{sign}', '{plain}')"
    runs = f"regexp_extract_all({x}, '[{_LETTERS}]+|[^{_LETTERS}]+')"
    disguised = f"regexp_matches(r, '^[A-Za-z{_FOREIGN}]+$') AND regexp_matches(r, '[A-Za-z]')"
    return f"nfc_normalize(array_to_string(list_transform({runs}, lambda r: CASE WHEN {disguised} THEN translate(r, '{_FOREIGN}', '{_LATIN}') ELSE r END), ''))"


_UNIFORM = " UNION ALL ".join(
    f"""SELECT rec_id, '{f}' AS field_name, "{f}" AS value, {_uniform_sql('"' + f + '"')} AS canonical FROM patent_utility_info WHERE "{f}" IS NOT NULL"""
    for f in TEXT_FIELDS
)


@query("p4_found", f"SELECT rec_id, field_name FROM ({_UNIFORM}) WHERE value <> canonical")
def p4_found(spark, d):
    forms = uniform_text(table(spark, d, "patent_utility_info"), TEXT_FIELDS, only_odd=True)
    return forms.select("rec_id", "field_name")


@query("p4_uniform", f"SELECT rec_id, field_name, canonical FROM ({_UNIFORM})")
def p4_uniform(spark, d):
    return uniform_text(table(spark, d, "patent_utility_info"), TEXT_FIELDS).select("rec_id", "field_name", "canonical")


# Problem 7: evaluation texts in training text.

_COMPACT = "regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', '', 'g')"
_LEAKS = f"""WITH d AS (SELECT doc_id, {_COMPACT} AS t FROM documents), i AS (SELECT item_id, {_COMPACT} AS t FROM eval_items),
  dr AS (SELECT doc_id, unnest(list_distinct([substr(t, k, 60) FOR k IN range(1, length(t) - 58)])) AS run FROM d WHERE length(t) >= 60),
  ir AS (SELECT DISTINCT item_id, unnest([substr(t, k, 60) FOR k IN range(1, length(t) - 58)]) AS run FROM i WHERE length(t) >= 60),
  found AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run))"""


@query("p7_found", f"{_LEAKS} SELECT doc_id, item_id FROM found")
def p7_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query(
    "p7_items",
    f"""{_LEAKS} SELECT i.item_id, count(DISTINCT f.doc_id) AS n_docs,
      count(DISTINCT CASE WHEN f.doc_id IS NOT NULL THEN coalesce(source, '') END) AS n_sources
    FROM eval_items i LEFT JOIN found f USING (item_id) LEFT JOIN documents s ON s.doc_id = f.doc_id GROUP BY 1""",
)
def p7_items(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leak_report(leaks(docs, items), docs, items)


# Problem 1: texts cut off.


@query("p1_found")
def p1_found(spark, d):
    return truncated(table(spark, d, "patent_utility_info")).filter("is_cut").select("rec_id")


@query("p1_sources")
def p1_sources(spark, d):
    return cut_shares(truncated(table(spark, d, "patent_utility_info")))


# Problem 8: mixing sources.


@query("p8_mix")
def p8_mix(spark, d):
    return mix(table(spark, d, "documents"), table(spark, d, "source_plan"))[0]


@query("p8_shares")
def p8_shares(spark, d):
    return mix(table(spark, d, "documents"), table(spark, d, "source_plan"))[1]


# Problem 9: splitting oversized texts.


@query("p9_pieces")
def p9_pieces(spark, d):
    return split_oversized(table(spark, d, "documents"), table(spark, d, "source_plan"))


# Problem 6: variant spellings of names.


def _name_classes(spark, d):
    return name_classes(table(spark, d, "patent_utility_info"), table(spark, d, "given_name_forms"))


@query("p6_found")
def p6_found(spark, d):
    return name_pairs(_name_classes(spark, d))


@query("p6_classes")
def p6_classes(spark, d):
    return _name_classes(spark, d)
