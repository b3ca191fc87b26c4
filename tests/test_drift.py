"""Drift from tables that add up against the report that reads every row."""

import datetime
import random

import pytest

from watchpost.operators import drift as dr
from watchpost.operators import quality as qu

SCHEMA = "district_id string, signal_type string, date date, value double, source_id string"
DAY = datetime.date(2024, 1, 1)


def rows(seed, days=70):
    rng, out = random.Random(seed), []
    for district in "abc":
        for kind in ("mortality", "search_fever", "icu_occupancy"):
            for d in range(days if kind != "icu_occupancy" else 12):
                value = round(rng.gauss(10 + (d > 55 and kind == "mortality") * 6, 2), rng.choice([0, 1, 6]))
                out.append((district, kind, DAY + datetime.timedelta(d), None if rng.random() < 0.05 else value, "s"))
    return out


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_from_counts_equal_the_full_ones(spark, seed):
    df = spark.createDataFrame(rows(seed), SCHEMA)
    full = [(s, p, d, r) for s, p, d, r in found(qu.drift_report(df.where("value is not null")))]
    assert found(dr.drift_from_sums(dr.day_sums(df))) == full and len(full) == 2
    # One value a day and series: days and rows are the same cut.
    got, want = (dict(found(x)) for x in (dr.district_drift_from_counts(dr.value_counts(df)), qu.district_drift(df)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got) and max(got.values()) > 0.1


def test_any_parts_add_up_to_the_whole(spark, tmp_path):
    own = rows(3) + [(d, k, t, v, "s2") for d, k, t, v, _ in rows(4) if t.day % 3]
    whole = spark.createDataFrame(own, SCHEMA)
    tables, rng = dr.DriftTables(spark, str(tmp_path), compact_after=2), random.Random(7)
    rng.shuffle(own)
    ends = [0, *sorted(rng.sample(range(1, len(own)), 3)), len(own)]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        part = spark.createDataFrame(own[a:b], SCHEMA)
        tables.add(part, "w", k)
        if k == 1:
            tables.add(part, "w", k)  # a replay
    tables.add(whole.limit(0), "w", 9)
    counts = lambda df: sorted((r.district_id, r.signal_type, r.date, r.value, r.n) for r in df.collect())
    assert counts(tables.counts.read()) == counts(dr.value_counts(whole))
    assert found(tables.drift_report()) == found(dr.drift_from_sums(dr.day_sums(whole)))
    assert dict(found(tables.district_drift())) == pytest.approx(dict(found(dr.district_drift_from_counts(dr.value_counts(whole)))))


def test_empty_and_short_series(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert dr.drift_from_sums(dr.day_sums(none)).count() == dr.district_drift_from_counts(dr.value_counts(none)).count() == 0
    few = spark.createDataFrame([("a", "mortality", DAY, 1.0, "s"), ("a", None, None, 2.0, "s"), (None, "mortality", DAY, float("nan"), "s")], SCHEMA)
    assert found(dr.district_drift_from_counts(dr.value_counts(few))) == [("a", 0.0)]
    tables = dr.DriftTables(spark, str(tmp_path))
    tables.add(few, "w", 0)
    tables.add(few, "w", 1)
    assert {r.n for r in tables.counts.read().collect()} == {2}
