"""Problem 8: water-filling and drawing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm.mixing import mix, water_fill

PLAN = "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int"
DOCS = "doc_id long, source string, text string, n_tokens long, uses int"


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.floats(0, 1), st.integers(0, 10**6)), min_size=1, max_size=12),
    st.integers(0, 10**7),
)
def test_water_fill(sources, total):
    shares = {str(i): w for i, (w, _) in enumerate(sources)}
    caps = {str(i): float(c) for i, (_, c) in enumerate(sources)}
    give = water_fill(shares, caps, total)
    usable = [s for s in shares if shares[s] > 1e-9 and caps[s] > 0]
    assert all(0 <= give[s] <= caps[s] * (1 + 1e-9) for s in give)
    reachable = min(total, sum(caps[s] for s in shares if shares[s] > 0))
    assert sum(give.values()) == pytest.approx(reachable, rel=1e-6, abs=1e-6)
    free = [s for s in usable if give[s] < caps[s] * (1 - 1e-9)]
    for a in free:  # proportional among the unclamped, and no clamped source would deserve less
        for b in usable:
            assert give[b] / shares[b] <= give[a] / shares[a] * (1 + 1e-6) + 1e-9


def docs(spark):
    rows = [(i, "big", "alpha beta gamma delta " * (1 + i % 7), 5, 5) for i in range(400)]
    rows += [(1000 + i, "small", "one two three four five", 5, 5) for i in range(10)]
    rows += [(2000, None, "x", 5, 5), (2001, "unplanned", "x", 5, 5), (2002, "big", None, 5, 5), (2003, "big", "", 5, 5), (2004, "small", "one two", 5, 5), (2004, "small", "one two", 5, 5)]
    return spark.createDataFrame(rows, DOCS)


def plan(spark, *rows):
    return spark.createDataFrame([(*r, 512, 64) for r in rows], PLAN)


def test_mix(spark):
    p = plan(spark, ("big", 0.5, 2), ("small", 0.3, 3), ("nothing", 0.2, 4), (None, 0.1, 1))
    uses, shares = mix(docs(spark), p)
    rows, report = uses.collect(), {r.source: r for r in shares.collect()}
    assert len(rows) == 414 and {r.source for r in rows} == {"big", "small"}
    assert max(r.uses for r in rows if r.source == "small") == 3 and max(r.uses for r in rows if r.source == "big") <= 2
    for s in ("big", "small"):
        used = sum(r.uses * r.n_tokens for r in rows if r.source == s)
        longest = max(r.n_tokens for r in rows if r.source == s)
        wanted = report[s].epochs * report[s].available_tokens
        assert wanted - longest <= used <= wanted + 1e-6 and report[s].used_tokens == used
    assert report["small"].is_capped and not report["big"].is_capped
    assert report["nothing"].used_tokens == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    again = mix(docs(spark), p)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    other = mix(docs(spark), p, seed=1)[0].collect()
    assert sorted(map(tuple, rows)) != sorted(map(tuple, other))


def test_exact_shares_where_feasible(spark):
    p = plan(spark, ("big", 0.9, 5), ("small", 0.1, 5))
    report = {r.source: r for r in mix(docs(spark), p, total_tokens=3000)[1].collect()}
    assert report["big"].actual_share == pytest.approx(0.9, abs=0.02)


def test_edges(spark):
    d = docs(spark)
    p = plan(spark, ("big", 0.5, 2), ("small", None, None))
    assert {r.uses for r in mix(d, p)[0].filter("source = 'small'").collect()} == {0}
    uses, shares = mix(d.limit(0), p)
    assert uses.count() == 0 and all(r.actual_share == 0 for r in shares.collect())
    assert mix(d, p.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        mix(d, plan(spark, ("big", 0.5, 2), ("big", 0.5, 2)))
