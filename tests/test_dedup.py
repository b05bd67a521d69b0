import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tremorlake.operators.dedup import dedup_both, dedup_fuzzy, dedup_latest
from tremorlake.schemas import UNIFIED_COLUMNS

SCHEMA = (
    "id string, dt date, magnitude double, mag_type string, place string, time_utc bigint, "
    "longitude double, latitude double, depth_km double, source_system string"
)
DAY = dt.date(2024, 1, 1)


def row(id="a", time=60_000, lat=1.0, lon=2.0, mag=1.0, source="USGS", place="p"):
    return (id, DAY, mag, "ml", place, time, lon, lat, 5.0, source)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted((r["id"] for r in df.collect()), key=lambda i: (i is None, i))


def test_latest_row_per_id(spark):
    df = dedup_latest(frame(spark, [row(time=1), row(time=3, place="new"), row(time=2), row(id="b")]))
    assert {(r["id"], r["place"]) for r in df.collect()} == {("a", "new"), ("b", "p")}


def test_equal_times_are_resolved_by_the_other_columns(spark):
    rows = [row(mag=m, place=p) for m in (1.0, 2.0) for p in ("x", "y")]
    for order in (rows, rows[::-1]):
        kept = dedup_latest(frame(spark, order)).collect()
        assert [(r["magnitude"], r["place"]) for r in kept] == [(2.0, "y")]


def test_null_ids_kept_or_collapsed(spark):
    df = frame(spark, [row(id=None, lat=1.0), row(id=None, lat=50.0), row(id=None, lat=50.0), row()])
    assert ids(dedup_latest(df)) == ["a", None, None, None]
    assert ids(dedup_latest(df, null_keys="collapse")) == ["a", None]
    with pytest.raises(ValueError):
        dedup_latest(df, null_keys="other")


def test_trusted_source_first_then_magnitude_then_id(spark):
    df = frame(
        spark,
        [row(id="t", source="Terraquake", mag=9.0), row(id="u1", mag=1.0), row(id="u2", mag=2.0)],
    )
    assert ids(dedup_fuzzy(df)) == ["u2"]
    assert ids(dedup_fuzzy(df, priority=("Terraquake", "USGS"))) == ["t"]
    assert ids(dedup_fuzzy(frame(spark, [row(id="b"), row(id="c"), row(id="a")]))) == ["c"]
    unlisted = frame(spark, [row(id="z", source="Zeta", mag=9.0), row(id="t", source="Terraquake")])
    assert ids(dedup_fuzzy(unlisted)) == ["t"]
    nulls = frame(spark, [row(id="n", mag=None), row(id="m", mag=-1.0)])
    assert ids(dedup_fuzzy(nulls)) == ["m"]


def test_buckets_are_calendar_minutes_and_fixed_cells(spark):
    minute_edge = frame(spark, [row(id="a", time=59_999), row(id="b", time=60_000)])
    assert ids(dedup_fuzzy(minute_edge)) == ["a", "b"]
    cell_edge = frame(spark, [row(id="a", lat=1.099), row(id="b", lat=1.101)])
    assert ids(dedup_fuzzy(cell_edge)) == ["a", "b"]
    around_zero = frame(spark, [row(id="a", lat=-0.05), row(id="b", lat=0.05)])
    assert ids(dedup_fuzzy(around_zero)) == ["a", "b"]
    same_negative_cell = frame(spark, [row(id="a", lat=-0.01, lon=-9.91), row(id="b", lat=-0.09, lon=-9.99)])
    assert ids(dedup_fuzzy(same_negative_cell)) == ["b"]


def test_rows_without_bucket(spark):
    rows = [row(id="a", time=None), row(id="b", time=None), row(id=None, lat=None), row(id=None, lat=None)]
    df = frame(spark, rows)
    assert ids(dedup_both(df)) == ["a", "b", None, None]
    # Collapsing leaves one row without id, then one row per group with a NULL bucket.
    assert ids(dedup_both(df, null_keys="collapse")) == ["b", None]


def test_a_hot_key_is_reduced_before_the_shuffle(spark, plan_of):
    rows = [row(id="hot", time=i) for i in range(3000)] + [row(id=str(i), lat=i / 100) for i in range(300)]
    df = dedup_latest(frame(spark, rows).repartition(8))
    plan = plan_of(df)
    assert plan.index("row_number(), 1, Final") < plan.index("row_number(), 1, Partial")
    kept = {r["id"]: r["time_utc"] for r in df.collect()}
    assert kept["hot"] == 2999 and len(kept) == 301


def reference_dedup(rows, null_keys):
    """Plain Python brute force over the same total orders."""
    named = [dict(zip(UNIFIED_COLUMNS, r)) for r in rows]

    def desc(value):
        return (value is not None, value if value is not None else 0)

    def best(group, first):
        rest = [c for c in UNIFIED_COLUMNS if c not in first]
        return max(group, key=lambda r: tuple(desc(r[c]) for c in (*first, *rest) if c != "dt"))

    def step(items, key, first):
        groups, free = {}, []
        for r in items:
            k = key(r)
            if null_keys == "keep" and None in k:
                free.append(r)
            else:
                groups.setdefault(k, []).append(r)
        return free + [best(g, first) for g in groups.values()]

    def bucket(r):
        def cell(v, by):
            return None if v is None else int(v * by // 1)

        t = r["time_utc"]
        return (None if t is None else t // 60_000, cell(r["latitude"], 10), cell(r["longitude"], 10))

    once = step(named, lambda r: (r["id"],), ["time_utc"])
    twice = step(once, bucket, ["source_system", "magnitude", "id"])
    return Counter(tuple(r[c] for c in UNIFIED_COLUMNS) for r in twice)


events = st.builds(
    row,
    id=st.sampled_from(["a", "b", "c", "d", None]),
    time=st.sampled_from([0, 59_000, 60_000, None]),
    lat=st.sampled_from([-0.05, 0.05, None]),
    lon=st.sampled_from([0.05, 0.06]),
    mag=st.sampled_from([1.0, 2.0, None]),
    source=st.sampled_from(["USGS", "Terraquake"]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(events, min_size=1, max_size=25), null_keys=st.sampled_from(["keep", "collapse"]))
def test_equals_brute_force_and_is_idempotent(spark, rows, null_keys):
    df = frame(spark, rows)
    clean = dedup_both(df, null_keys=null_keys)
    got = Counter(tuple(r) for r in clean.collect())
    assert got == reference_dedup(rows, null_keys)
    assert Counter(tuple(r) for r in dedup_both(clean, null_keys=null_keys).collect()) == got
    assert not got - Counter(rows)
