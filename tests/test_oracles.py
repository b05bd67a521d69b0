"""Every registered query against its SQL on the smallest test data."""

import __spark_entry__ as entry_module
import oracle
import pytest
from paths import SMALL

from tremorlake.checks.catalog import CHECKS


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, name, SMALL) == ""


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["dt", "region_id", "total_events"]
    assert df.count() > 0


def test_entry_lists_match():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_shown_null_is_not_a_number(spark):
    from tremorlake.checks.present import shown

    kinds = {"a": "int", "b": "r6", "c": "text", "d": "day", "e": "num"}
    row = spark.sql("select cast(null as int) a, cast(null as double) b, cast(null as string) c, cast(null as date) d, cast(null as double) e")
    assert shown(row, kinds).collect() == [(None,) * 5]
