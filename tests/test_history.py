"""Decision log: latest entry, comparison, listing, append, JSON form."""

import pytest
from pyspark.sql import functions as F

from docketry import config as C
from docketry.operators import history as H
from docketry.sinks.log import append_entries
from docketry.sources.json_log import parse_log, read_log

LOG = "ord long, " + ", ".join(f"{f} {'double' if f.startswith('relevance') else 'string'}" for f in H.ENTRY_FIELDS)


def entry(ord_, number, time, status="공개", applicant="A사", ipc="H01M"):
    return (ord_, number, "t", "관련 있음", "r", time, status, applicant, ipc, 1.0, "p")


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [
            entry(1, "1", "2026-01-01T09:00:00+09:00"),
            entry(2, "1", "2026-02-01T09:00:00+09:00", applicant="A  사", ipc="H01M|B60L"),
            entry(3, "1", "2026-02-01T09:00:00+09:00", status="거절"),
            entry(4, "", "2026-03-01T09:00:00+09:00"),
            entry(5, None, None),
            entry(6, "9", None),
        ],
        LOG,
    )


def current(spark, *rows):
    return spark.createDataFrame(list(rows), "application_number string, register_status string, applicant string, ipc string")


def test_differences(spark, log):
    df = current(
        spark, ("1", "공개", " A 사 ", "H01M|B60L"), ("1", "등록", "A 사", "H01M|B60L"), ("1", "공개", "A 사", "B60L|H01M"),
        ("2", "공개", "x", "y"), ("", "공개", "x", "y"), (None, None, None, None),
    )
    got = H.compare_with_latest(df, log).collect()
    by = [([tuple(d) for d in r.differences], r.review_state, r.n_entries) for r in got]
    assert ([], C.STATE_SAME, 3) in by
    assert ([("등록상태", "공개", "등록")], C.STATE_CHANGED, 3) in by
    assert ([("IPC", "H01M|B60L", "B60L|H01M")], C.STATE_CHANGED, 3) in by
    assert sum(s == C.STATE_NONE and n == 0 and d == [] for d, s, n in by) == 3 and len(by) == 6


def test_latest_takes_first_of_equal_times(log):
    rows = {r.applicationNumber: r for r in H.latest_entries(log).collect()}
    assert set(rows) == {"1", "9"} and rows["1"].ord == 2 and rows["1"].n_entries == 3


def test_listing(log):
    got = {r.ord: r.position for r in H.history_listing(log).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 6: 1}


def test_listing_of_a_hot_application(spark):
    """Most entries on one application, many of one day, ties in time and number."""
    import random

    rng = random.Random(3)
    times = [None, "", "2026-01-01T10:00:00Z", "2026-01-01T11:00:00Z", "2026-01-02T10:00:00Z", "2025-12-31T23:00:00Z"]
    rows = [entry(i // 2, "1" if i % 4 else f"n{i}", rng.choice(times), status=str(i)) for i in range(400)]
    rows += [entry(7, None, times[2])] * 3
    df = spark.createDataFrame(rows, LOG).repartition(5)
    got = {(r.applicationNumber, r.position): r for r in H.history_listing(df).collect()}
    by = {}
    for r in rows:
        if r[1]:
            by.setdefault(r[1], []).append(r)
    assert len(got) == sum(map(len, by.values()))
    for k, entries in by.items():
        entries.sort(key=lambda r: (r[0], r[6]))
        entries.sort(key=lambda r: r[5] or "", reverse=True)
        assert [(got[k, i].ord, got[k, i].decisionTime or "") for i in range(1, len(entries) + 1)] == [(r[0], r[5] or "") for r in entries]
    pages = {(r.applicationNumber, r.page): [e.position for e in r.entries] for r in H.history_pages(df, 100).collect()}
    assert [pages["1", p] for p in (1, 2, 3)] == [list(range(1, 101)), list(range(101, 201)), list(range(201, 301))]
    records = current(spark, ("1", "", "", ""), ("zz", "", "", ""), ("", "", "", ""), (None, "", "", "")).withColumn("position", F.lit(1))
    found = H.with_history(records, df, 100).collect()
    assert sorted((r.application_number or "", r.page or 0, len(r.entries or [])) for r in found) == [
        ("", 0, 0), ("", 0, 0), ("1", 1, 100), ("1", 2, 100), ("1", 3, 100), ("zz", 0, 0),
    ]


def test_latest_of_equal_numbers(spark):
    rows = [entry(1, "1", "2026", status=s) for s in "acb"]
    for part in (rows, rows[::-1]):
        assert H.latest_entries(spark.createDataFrame(part, LOG)).first().registerStatusAtDecision == "c"


def test_display(spark, log):
    df = current(spark, ("1", "", "B", "H01M|B60L")).withColumn("title", F.lit(""))
    shown = H.displayed(df).first()
    assert (shown.title, shown.register_status, shown.applicant) == (C.UNTITLED, "-", "B")
    rows = {r.field: (r.previous, r.current) for r in H.displayed_differences(H.compare_with_latest(df, log)).collect()}
    assert rows["등록상태"] == ("공개", C.EMPTY_SNAPSHOT)


def test_reviewed(spark, log):
    df = current(spark, ("1", "", "", ""), ("2", "", "", ""), (None, "", "", ""))
    assert [r.application_number for r in H.reviewed(df, log).collect()] == ["1"]
    assert {r.application_number for r in H.unreviewed(df, log).collect()} == {"2", None}


def test_empty_log(spark, log):
    df = current(spark, ("1", "공개", "A", "B"))
    assert H.compare_with_latest(df, log.limit(0)).first().review_state == C.STATE_NONE


def test_append_keeps_history(spark, tmp_path):
    records = spark.createDataFrame(
        [(None, "1", "a", "s", "i", 5.0, "p")],
        "title string, application_number string, applicant string, register_status string, ipc string, relevance_score double, review_priority string",
    )
    entries = H.decision_entries(records, "관련 있음", " why \n")
    path = str(tmp_path / "log")
    append_entries(spark, entries, path)
    first = spark.read.parquet(path).collect()
    append_entries(spark, entries, path)
    rows = spark.read.parquet(path).orderBy("ord").collect()
    assert len(rows) == 2 and rows[0] == first[0] and rows[1].ord > rows[0].ord
    assert rows[0].decisionReason == "why" and rows[0].inventionTitle == ""
    assert rows[0].decisionTime.endswith("+00:00")
    assert H.compare_with_latest(records, spark.read.parquet(path)).first().review_state == C.STATE_SAME
    with pytest.raises(ValueError):
        H.decision_entries(records, "maybe", "")


def test_json_log(spark, tmp_path):
    def parsed(text):
        return parse_log(spark.createDataFrame([(text,)], "value string")).collect()

    assert parsed("[]") == []
    rows = parsed('[{"applicationNumber":"1"},5,"s",{"applicationNumber":"2"},null,[1]]')
    assert [(r.ord, r.applicationNumber) for r in rows] == [(0, "1"), (3, "2")]
    for bad in ('{"a":"1"}', '[{"a":"1"},'):
        with pytest.raises(Exception, match="damaged"):
            parsed(bad)
    assert read_log(spark, str(tmp_path / "missing.json")).count() == 0


def test_changed_fields_long_form(spark, log):
    df = current(spark, ("1", "등록", "B", "H01M|B60L")).withColumn("extra", F.lit(1))
    assert {r.field for r in H.changed_fields(H.compare_with_latest(df, log)).collect()} == {"등록상태", "출원인"}
