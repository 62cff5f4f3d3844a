"""Golden cases of scoring, keywords, codes, bands and ranking, and an exhaustive truth table."""

import itertools

import pytest
from pyspark.sql import functions as F

from docketry import config as C
from docketry.functions.ipc import compact_codes, has_family
from docketry.functions.keywords import keywords
from docketry.operators.ranking import band_summary, ranked, top, with_rank
from docketry.operators.scoring import badge, band, mode_notice, score_records
from docketry.plans.queries import PHRASES

TECH = "전기차 배터리 냉각"
SCHEMA = "ord long, title string, abstract string, ipc string"


def scored(spark, tech, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return score_records(df, tech, **options).orderBy("ord").collect()


CONCEPT = [
    (("전기차 배터리 냉각 장치", "배터리 냉각수를 순환", "H01M 10/613; B60L 50/64"), 92.0, C.PRIORITY_HIGH,
     "vehicle;battery;cooling;IPC:H01M;IPC:B60L",
     "배터리·냉각 개념 모두 확인, 차량 개념 확인, 제목에서 차량·배터리·냉각 발견, 초록에서 배터리·냉각 발견, H01M/B60L IPC 확인"),
    (("냉간 단조 방법", "", ""), 0.0, C.PRIORITY_LOW, "", C.NO_CONCEPT_REASON),
    (("배터리 팩", "차량용", "H01M 10/613 B60L 50/64"), 38.0, C.PRIORITY_LOW, "vehicle;battery;IPC:H01M",
     "배터리 개념 확인, 차량 개념 확인, 제목에서 배터리 발견, 초록에서 차량 발견, H01M IPC 확인"),
    (("펌프", "배터리와 열교환기", ""), 70.0, C.PRIORITY_HIGH, "battery;cooling", "배터리·냉각 개념 모두 확인, 초록에서 배터리·냉각 발견"),
    ((None, None, "B60L 1/00"), 2.0, C.PRIORITY_LOW, "IPC:B60L", "B60L IPC 확인"),
    (("전기 자동차 모터", "", None), 8.0, C.PRIORITY_LOW, "vehicle", "차량 개념 확인, 제목에서 차량 발견"),
]


def test_concepts(spark):
    got = scored(spark, TECH, [c[0] for c in CONCEPT])
    for r, (_, score, priority, matched, reason) in zip(got, CONCEPT):
        assert (r.relevance_score, r.review_priority, r.matched_concepts, r.score_reason) == (score, priority, matched, reason)
        assert r.analysis_mode == "concept_group"


def test_untargeted_groups_count_nothing(spark):
    (r,) = scored(spark, "배터리", [("전기차 배터리 냉각", "배터리", "B60L 1; H01M 1")])
    assert (r.relevance_score, r.matched_concepts) == (33.0, "battery;IPC:H01M")


def test_truth_table(spark):
    """Every state of hits for every target set against independent arithmetic."""
    word = {"vehicle": "차량", "battery": "배터리", "cooling": "냉각"}
    total, best = 0, 0
    for n in (1, 2, 3):
        for target in itertools.combinations(word, n):
            codes = [c for c, g in (("H01M", "battery"), ("B60L", "vehicle")) if g in target]
            states = list(itertools.product([0, 1], repeat=2 * n + len(codes)))
            rows = []
            for s in states:
                t, a, k = s[:n], s[n : 2 * n], s[2 * n :]
                text = lambda flags: " ".join(word[g] for g, f in zip(target, flags) if f)
                rows.append((text(t), text(a), ";".join(f"{c} 1/00" for c, f in zip(codes, k) if f)))
            for s, r in zip(states, scored(spark, " ".join(word[g] for g in target), rows)):
                t, a, k = (dict(zip(target, s[:n])), dict(zip(target, s[n : 2 * n])), s[2 * n :])
                has = {g: t.get(g, 0) or a.get(g, 0) for g in word}
                want = sum({"vehicle": 3, "battery": 4, "cooling": 6}[g] for g in t if t[g])
                want += sum({"vehicle": 2, "battery": 2, "cooling": 3}[g] for g in a if a[g])
                want += 65 if has["battery"] and has["cooling"] else 25 if has["battery"] or has["cooling"] else 0
                want += 5 * bool(has["vehicle"]) + 2 * sum(k)
                assert r.relevance_score == want
                total, best = total + 1, max(best, want)
    assert (total, best) == (404, 94)


GENERIC = "반도체 식각 공정을 위한 장치"


def test_keywords_score(spark):
    a, b = scored(spark, GENERIC, [("반도체 식각 장치", "플라즈마 식각 공정", ""), ("플라즈마 공정", "반도체 장치", "H01M 10/60")])
    assert (a.relevance_score, a.matched_concepts, a.review_priority) == (65.2, "반도체;식각;공정", C.PRIORITY_MEDIUM)
    assert a.score_reason == "제목 키워드: 반도체·식각, 초록 키워드: 식각·공정, 복수 키워드 동시 발견 (+3점)"
    assert (b.relevance_score, b.matched_concepts) == (43.5, "공정;반도체")
    assert b.score_reason == "제목 키워드: 공정, 초록 키워드: 반도체, 복수 키워드 동시 발견 (+3점), IPC 보조 확인: H01M"
    (c,) = scored(spark, "AI", [("AI 카메라", "", "")])
    assert (c.relevance_score, c.matched_concepts, c.analysis_mode) == (50.0, "ai", "generic_keyword")
    (d,) = scored(spark, "방법 및 장치", [("anything", "anything", "")])
    assert (d.relevance_score, d.score_reason) == (0.0, C.NO_KEYWORD_REASON)


def test_fallback_none(spark):
    (r,) = scored(spark, GENERIC, [("반도체", "", "")], cfg=C.ScoringConfig(fallback="none"))
    assert r.relevance_score == 0 and r.score_reason == C.NO_GROUP_REASON and "analysis_mode" not in r.asDict()


@pytest.mark.parametrize("phrase,expected", PHRASES)
def test_keyword_extraction(phrase, expected):
    assert ";".join(keywords(phrase)) == expected


def test_families(spark):
    cases = [
        ("H01M 10/613; B60L 50/64", True, True), ("H01M 10/613 B60L 50/64", True, False), ("h01m", True, False),
        ("XH01M10", False, False), ("H01MX", False, False), ("A47J|B60L", False, True), (None, False, False),
    ]
    df = spark.createDataFrame(cases, "ipc string, h boolean, b boolean")
    c = compact_codes(F.col("ipc"))
    assert df.filter((has_family(c, "H01M") != F.col("h")) | (has_family(c, "B60L") != F.col("b"))).isEmpty()


def test_bands_and_badges(spark):
    df = spark.createDataFrame([(39.9,), (40.0,), (69.9,), (70.0,), (None,), (float("nan"),)], "s double")
    bands = [r[0] for r in df.select(band(F.col("s"))).collect()]
    assert bands == [C.PRIORITY_LOW, C.PRIORITY_MEDIUM, C.PRIORITY_MEDIUM, C.PRIORITY_HIGH, C.PRIORITY_LOW, C.PRIORITY_LOW]
    marks = spark.createDataFrame([(C.PRIORITY_HIGH,), ("?",)], "p string").select(badge(F.col("p"))).collect()
    assert [m[0] for m in marks] == ["🔴 " + C.PRIORITY_HIGH, "⚪ ?"]


def test_ranking(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0), (3, 2.0)], "ord long, relevance_score double")
    assert [r.ord for r in ranked(df).collect()] == [1, 3, 0, 2]
    assert [r.ord for r in top(df, 3).collect()] == [1, 3, 0]
    assert {r.ord: r["rank"] for r in with_rank(df).collect()} == {1: 1, 3: 2, 0: 3, 2: 4}
    many = spark.range(200_000).select(F.col("id").alias("ord"), F.lit(5.0).alias("relevance_score"))
    assert with_rank(many).filter("rank <> ord + 1").isEmpty()
    with pytest.raises(ValueError):
        top(df, 0)


def test_summary_counts_empty_bands(spark):
    df = spark.createDataFrame([(C.PRIORITY_HIGH,)], "review_priority string")
    assert tuple(band_summary(df).first()) == (1, 1, 0, 0)
    assert tuple(band_summary(df.limit(0)).first()) == (0, 0, 0, 0)


def test_notice():
    assert mode_notice("배터리") == "" and mode_notice("반도체") == C.GENERIC_NOTICE


def test_existing_columns_are_overwritten_and_kept(spark):
    df = spark.createDataFrame([(0, "배터리", "냉각", "", 5.0, "x")], SCHEMA + ", relevance_score double, other string")
    r = score_records(df, TECH).first()
    assert r.relevance_score == 72.0 and r.other == "x"
    assert score_records(df.limit(0), TECH).count() == 0


def test_known_deviation_of_folding(spark):
    """Full case folding would make ß match ss; the engine lowers only."""
    (r,) = scored(spark, "strasse", [("Straße", "", "")])
    assert r.relevance_score == 0.0
