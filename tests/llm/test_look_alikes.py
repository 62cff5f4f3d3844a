"""Problem 4: which values are odd, and their one form."""

import unicodedata

from docketry.llm.look_alikes import plain, uniform_text

ODD = {
    "ＡBC １２": "ABC 12", "a​b": "ab", "a b": "a b", "a　b": "a b", "﻿x": "x", "co­op": "coop",
    "25 ℃": "25 °C", "5 ㎜": "5 mm", "3 Å": "3 Å", "3 Å": "3 Å", "2 Ω": "2 Ω", "7 µm": "7 μm",
    "ﬁlm": "film", unicodedata.normalize("NFD", "배터리 냉각"): "배터리 냉각", "P\u0422\u0421 연동": "PTC 연동", "USΒ": "USB",
    "mοdule": "module", "sоlаr": "solar", "​": "", "kΡa": "kPa", "éte": "éte", "\U0001d400b": "Ab",
}
PLAIN = [
    "배터리 냉각", "α상, β-실리콘", "25 °C, 3 Å, 10 kΩ, 7 μm", "tabs\tand\nlines", "“quotes” – dash… · ×", "broken �", "", " ",
    "привет мир", "хор", "Хор поёт, а оркестр играет в срок", "το νερο ρεει και το νεο", "ΝΕΑ", "Х축", "λόγος", "Ω 및 Α-형", "漢字かな", "x" * 100_000,
]


def test_outside_sql():
    assert {v: plain(v) for v in ODD} == ODD and [plain(v) for v in PLAIN] == PLAIN


def test_forms(spark):
    values = [*ODD, *PLAIN, None, *list(ODD)[:3]]
    rows = [(i, v, v, "clash", "clash") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "rec_id long, a string, b string, canonical string, seen string")
    got = uniform_text(df, ("a", "b")).collect()
    assert len(got) == 2 * (len(values) - 1)
    for r in got:
        expected = ODD.get(r.value, r.value)
        assert r.canonical == expected, (r.value, r.canonical)
        assert r.odd == (r.value in ODD), r.value
    only = uniform_text(df, ("a", "b"), only_odd=True).collect()
    assert sorted((r.rec_id, r.field_name) for r in only) == sorted((r.rec_id, r.field_name) for r in got if r.odd)
    assert uniform_text(df.limit(0), ("a",)).count() == 0


def test_equal_looks_become_equal(spark):
    forms = ["PTC 냉각", "P\u0422\u0421 냉각", "ＰＴＣ 냉각", "PTC 냉각", unicodedata.normalize("NFD", "PTC 냉각"), "P​TC 냉각"]
    df = spark.createDataFrame(list(enumerate(forms)), "rec_id long, t string")
    assert {r.canonical for r in uniform_text(df, ("t",)).collect()} == {"PTC 냉각"}


def test_everything_nfc_changes_is_odd(spark):
    """Characters that composition replaces are odd without an ordinary twin among the values."""
    values = ["\uf900 a", "b\u037e", "c\u0387d", "\u2329e\u232a", "f\u1fef", "\u304b\u3099"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "rec_id long, a string")
    got = {r.value: (r.canonical, r.odd) for r in uniform_text(df, ("a",)).collect()}
    assert got == {v: (unicodedata.normalize("NFC", v), True) for v in values}
