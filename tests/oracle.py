"""Runs a registered query on Spark and on DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

from tremorlake.checks.catalog import CHECKS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when equal, else what differs."""
    check = CHECKS[name]
    df = check.run(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    if check.sql is None:
        return "" if got else "no rows"
    cursor = con.execute(check.sql)
    names = [item[0] for item in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    kinds = [{type(v).__name__ for v in column} for column in zip(*got)]
    expected_kinds = [{type(v).__name__ for v in column} for column in zip(*expected)]
    if kinds != expected_kinds:
        return f"types {dict(zip(columns, kinds))} against {dict(zip(columns, expected_kinds))}"
    if got == expected:
        return ""
    missing, extra = list((expected - got).items())[:3], list((got - expected).items())[:3]
    return (
        f"{sum(got.values())} rows against {sum(expected.values())}; "
        f"{sum((expected - got).values())} missing {missing}, {sum((got - expected).values())} extra {extra}"
    )
