"""Problems 2, 3 and 5: edge cases and comparison with plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docketry.operators import validity
from docketry.operators.snapshots import snapshot_changes
from docketry.operators.unpack import delimiter_scores, unpack_codes
from docketry.operators.validity import change_events, versions

SNAP = "snapshot_no int, loaded_at timestamp, applicationNumber string, applicantName string, registerStatus string, at int, key string"


def snapshots(spark, rows):
    raw = spark.createDataFrame(
        [(n, t, k, a, s, 1, "clash") for n, t, k, a, s in rows],
        SNAP.replace("loaded_at timestamp", "loaded_at string"),
    )
    return raw.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))


K1, K2, K3 = "1020200000001", "10-2020-0000002", "10 2020 0000003"
D1, D2, D3 = "1020200000001", "1020200000002", "1020200000003"


def test_snapshots(spark):
    t1, t2 = "2026-01-01 00:00:00", "2026-01-02 00:00:00"
    df = snapshots(
        spark,
        [
            (1, t1, K1, "A", "공개"), (1, t1, K1, "A", "공개"), (1, t1, K2, None, "등록"), (1, t2, K3, "C", "등록"), (1, t1, K3, "C", "공개"),
            (3, t1, K1, " A ", "공개\t"), (3, t1, D2, "", "등록"), (3, None, D3, "Z", "소멸"), (3, t1, D3, "C", "거절"),
            (4, t1, K1, "B", "등록"), (4, t1, "12", "x", "y"), (4, t1, None, "x", "y"), (None, t1, K2, "x", "y"),
            (7, t1, "", None, None),
        ],
    )
    got = {(r.snapshot_no, r.application_number): (r.change_kind, r.changed_fields) for r in snapshot_changes(df).collect()}
    assert got == {
        (3, D3): ("changed", ["registerStatus"]),
        (4, D1): ("changed", ["applicantName", "registerStatus"]),
        (4, D2): ("removed", []),
        (4, D3): ("removed", []),
        (7, D1): ("removed", []),
    }
    assert snapshot_changes(df.limit(0)).count() == 0
    assert snapshot_changes(df.filter("snapshot_no = 1")).count() == 0


def test_snapshots_against_plain_python(spark):
    """With the chain of numbers broadcast or not."""
    rng = random.Random(1)
    rows = [(n, "2026-01-01", f"10202000000{k:02d}", rng.choice("ab"), rng.choice("xy")) for n in (1, 2, 5, 9) for k in range(40) if rng.random() < 0.7]
    by = defaultdict(dict)
    for n, _, k, a, s in rows:
        by[n][k] = (a, s)
    want = []
    for old, new in ((1, 2), (2, 5), (5, 9)):
        for k in by[old].keys() | by[new].keys():
            if by[old].get(k) != by[new].get(k):
                want.append((new, k, "added" if k not in by[old] else "removed" if k not in by[new] else "changed"))
    df = snapshots(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("-1", before):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert sorted(map(tuple, snapshot_changes(df).drop("changed_fields").collect())) == sorted(want)


FIELDS = ("registerStatusAtDecision", "applicantNameAtDecision", "ipcNumberAtDecision")
LOG = "ord long, applicationNumber string, decisionTime string, " + ", ".join(f"{f} string" for f in FIELDS) + ", n int, slice string"


def log(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], LOG)


def test_versions(spark):
    df = log(
        spark,
        [
            (1, K1, "2026-01-01T09:00:00+09:00", "a", "x", None), (2, K1, "2026-01-01T00:00:00Z", "b", "x", ""),
            (3, K1, "2026-01-02T00:00:00Z", " a ", "x", " "), (4, K1, "2026-01-03T00:00:00-05:00", "b", "x", ""),
            (5, K1, "2026-03-03T00:00:00Z", "a", "x", ""), (6, K1, "미상", "c", "x", ""), (7, K1, None, "c", "x", ""), (8, "12", "2026-01-01T00:00:00Z", "c", "", ""),
            (9, None, "2026-01-01T00:00:00Z", None, None, None), (None, K2, "2026-01-01T00:00:00Z", None, None, None), (0, K2, "2026-01-01T00:00:00Z", "z", None, None),
        ],
    )
    got = sorted(tuple(r)[:4] for r in versions(df).collect())
    day = 86_400
    t0 = 1767225600  # 2026-01-01T00:00:00Z
    assert got == [
        (D1, t0, t0 + 2 * day + 5 * 3600, "a"),
        (D1, t0 + 2 * day + 5 * 3600, t0 + 61 * day, "b"),
        (D1, t0 + 61 * day, 0, "a"),
        (D2, t0, 0, "z"),
    ]
    assert versions(df.limit(0)).count() == 0
    kinds = [r.event for r in change_events(df, FIELDS).filter(F.col("key") == D1).collect()]
    assert sorted(kinds) == ["changed", "changed", "deleted", "inserted"]


def test_versions_against_plain_python(spark, monkeypatch):
    """A hot key with most entries, ties, and slices of very different lengths give the same versions."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = D1 if rng.random() < 0.6 else f"10202000{rng.randrange(10**5):05d}"
        at = 1_700_000_000 + rng.randrange(200) * rng.choice([1, 3600, 86_400])
        rows.append((i, key, at, rng.choice("ab"), rng.choice("x "), None))
    by = defaultdict(dict)
    for i, k, at, *v in rows:
        by[k].setdefault(at, tuple((x or "").strip() for x in v))
    want = []
    for k, entries in by.items():
        runs = []
        for at in sorted(entries):
            if not runs or runs[-1][1] != entries[at]:
                runs.append((at, entries[at]))
        want += [(k, a, b) for (a, _), (b, _) in zip(runs, runs[1:] + [(0, None)])]
    df = log(spark, rows and [(r[0], r[1], None, *r[3:]) for r in rows]).drop("decisionTime")
    times = spark.createDataFrame([(r[0], r[2]) for r in rows], "ord long, s long")
    df = df.join(times, "ord").withColumn("decisionTime", F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    for seconds in (validity.SLICE_SECONDS, 1000):
        monkeypatch.setattr(validity, "SLICE_SECONDS", seconds)
        got = versions(df).select("application_number", "valid_from", "valid_to").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_unpack(spark):
    cases = {
        "\"H01M 10/613 (구 H01M 1/00)\"; h01m-1/02": ["H01M 10/613", "H01M 1/02"],
        "H01M 10/613,48/04;B60L 1/00": ["H01M 10/613", "H01M 48/04", "B60L 1/00"],
        "H01M0010613000|B60L0001000000 F16K0002060000": ["H01M 10/613", "B60L 1/00", "F16K 2/06"],
        "1) H01M 1/02 2) B60L": ["H01M 1/02", "B60L"],
        "['H01M 1/02', 'H01M 1/02']": ["H01M 1/02", "H01M 1/02"],
        "G01N\t5 / 10  C02F  2/06": ["G01N 5/10", "C02F 2/06"],
        "12/34; H01M": ["H01M"],
        "N/A": [], "-": [], "": [], " ": [], "미부여; A61M1/00 · 2/04\nB60L": ["A61M 1/00", "A61M 2/04", "B60L"],
        "(unclosed H01M 1/00": [], None: [], ";".join(["H01M 10/613"] * 3000): ["H01M 10/613"] * 3000,
    }
    rows = [(i, c, "s" if i % 2 else None, 5, "clash") for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "rec_id long, ipcNumber string, source string, pos int, text string")
    got = defaultdict(list)
    for r in unpack_codes(df).orderBy("rec_id", "pos").collect():
        got[r.rec_id].append(r.ipc_code)
        assert r.pos == len(got[r.rec_id])
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert unpack_codes(df.limit(0)).count() == 0
    assert delimiter_scores(df.limit(0)).count() == 0


def test_delimiters_are_told_apart(spark):
    rows = [(i, "H01M 1/02; B60L 3/04" if i % 2 else "H01M, 1/02", "s") for i in range(10)]
    df = spark.createDataFrame(rows, "rec_id long, ipcNumber string, source string")
    got = {(r.layout, r.delimiter): r.accepted for r in delimiter_scores(df).collect()}
    assert got == {("semicolon", "semicolon"): True, ("comma", "comma"): True}


def test_delimiters_make_the_rows(spark, monkeypatch):
    """A mark that separates nothing but codes is a delimiter; without inference packed values give no code."""
    rows = [(1, "A01B 1/00; A01B 2/00", "s"), (2, "H01M 1/02", "s"), (3, "about 12, see; H01M 1/02 (x), 7 of 9, 8", "t")]
    df = spark.createDataFrame(rows, "rec_id long, ipcNumber string, source string")
    codes = lambda: sorted((r.rec_id, r.ipc_code) for r in unpack_codes(df).collect())
    assert codes() == [(1, "A01B 1/00"), (1, "A01B 2/00"), (2, "H01M 1/02")]
    assert {r.delimiter: r.accepted for r in delimiter_scores(df).filter("source = 't'").collect()} == {"semicolon": False, "comma": False}
    monkeypatch.setattr("docketry.operators.unpack.MIN_REGULAR", 2.0)
    assert codes() == [(2, "H01M 1/02")]


def test_place_holders_beside_codes(spark):
    cases = ["- H01M 1/02 N/A", "H01M -", "미부여 H01M", "H01M 1/02\t-\tB60L 2/00 12/04", "1) H01M 2) 미부여 3) B60L 1/00"]
    df = spark.createDataFrame([(i, c, f"s{i}") for i, c in enumerate(cases)], "rec_id long, ipcNumber string, source string")
    got = defaultdict(list)
    for r in unpack_codes(df).orderBy("rec_id", "pos").collect():
        got[r.rec_id].append(r.ipc_code)
    assert [got[i] for i in range(len(cases))] == [["H01M 1/02"], ["H01M"], ["H01M"], ["H01M 1/02", "B60L 2/00", "B60L 12/04"], ["H01M", "B60L 1/00"]]
