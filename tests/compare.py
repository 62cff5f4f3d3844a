"""Compare a registered query with its SQL over one of the test scales."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "patent_utility_info", "patent_snapshots", "judgments", "eval_items", "source_plan", "given_name_forms",
)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6))
        return repr(x)

    return sorted(tuple(value(r[i]) for i in order) for r in data)


def same(spark, name: str, fn, sql: str, sf_dir: str) -> None:
    df = fn(spark, sf_dir)
    cursor = duck(sf_dir).execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns), (name, names, df.columns)
    expected, got = rows(names, cursor.fetchall()), rows(df.columns, df.collect())
    extra, missing = set(got) - set(expected), set(expected) - set(got)
    assert got == expected, (name, len(got), len(expected), sorted(extra)[:5], sorted(missing)[:5])
