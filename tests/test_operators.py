"""Properties and edge cases of the operators on small tables."""

import datetime
import inspect

import pytest
from pyspark.sql import functions as F

from watchpost.functions import scoring as sc
from watchpost.functions import stats as st
from watchpost.operators import alerts as al
from watchpost.operators import detectors as de
from watchpost.operators import features as fe
from watchpost.operators import graph as gr
from watchpost.operators import models as mo
from watchpost.operators import policy as po
from watchpost.operators import projection as pr
from watchpost.operators import quality as qu
from watchpost.operators import risk as ri
from watchpost.operators import rollups as ro
from watchpost.plans import jobs, registry
from watchpost.sources import ingest as ing
from watchpost.sources import store

AGG = "district_id string, date date, signal_type string, value double"
RAW = AGG + ", source_id string"


def series(spark, days, signals=("social_mentions",), districts=("a", "b"), peak=None):
    """Deterministic noise; in district a, a peak over the last days."""
    base = spark.range(days).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("k"))
    for name, values in (("district_id", districts), ("signal_type", signals)):
        base = base.crossJoin(spark.createDataFrame([(v,) for v in values], f"{name} string"))
    noise = 50 + F.pmod(F.xxhash64("k", "district_id", "signal_type"), F.lit(1000)) / 200
    raised = F.when((F.col("district_id") == "a") & (F.col("k") >= days - (peak or 0)), 40.0).otherwise(0.0)
    return base.select("district_id", "date", "signal_type", (noise + raised).alias("value"))


def test_level_and_anomaly_thresholds(spark):
    got = spark.createDataFrame([(5.0,), (20.0,), (40.0,), (60.0,), (80.0,)], "r double").select(sc.level_for("r").alias("l")).collect()
    assert [x.l for x in got] == ["Normal", "Watch", "Warning", "Alert", "Emergency"]
    got = spark.createDataFrame([(2.0,), (4.0,), (9.0,), (-5.0,)], "z double").select(sc.anomaly_from_z("z").alias("a")).collect()
    assert [x.a for x in got] == [0.0, 0.5, 1.0, 0.0]


@pytest.mark.parametrize("rows", [13, 14, 27])
def test_short_series_have_no_z(spark, rows):
    z = st.rolling_robust_z(series(spark, rows, districts=("b",))).agg(F.max(F.abs("z"))).first()[0]
    assert z == 0.0 if rows < 14 else z >= 0.0


def test_constant_series_have_no_z(spark):
    flat = series(spark, 40).withColumn("value", F.lit(7.0))
    assert st.rolling_robust_z(flat).where("z <> 0").count() == 0


def test_peak_is_found_where_it_is(spark):
    agg = series(spark, 90, peak=6)
    got = {r.district_id: r.m for r in de.detect_social(agg).where("date >= '2024-03-26'").groupBy("district_id").agg(F.max("score").alias("m")).collect()}
    assert got["a"] > 0.5 > got["b"]


def test_missing_detector_is_renormalised(spark):
    wide = spark.createDataFrame([("a", datetime.date(2024, 1, 1), None, 0.5, None, None)], "district_id string, date date, search double, hospital double, social double, wastewater double")
    assert ri.risk_score(wide).first().risk_score == 50.0
    confidence = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 0.0)], "district_id string, date date, confidence double")
    assert ri.risk_score(wide, confidence).first().risk_score == 35.0


def test_weighted_mean_of_missing_values(spark):
    day = datetime.date(2024, 1, 1)
    raw = spark.createDataFrame([("a", day, "x", 4.0, "s"), ("a", day, "x", None, "t"), ("a", day, "y", float("nan"), "s"), (None, day, "x", 1.0, "s")], RAW)
    weights = spark.createDataFrame([("s", 0.5), ("t", 0.5)], "source_id string, reliability double")
    got = {r.signal_type: r.value for r in fe.weighted_source_mean(raw, weights).collect()}
    assert got == {"x": 2.0, "y": 0.0}


def test_corruption_lowers_reliability(spark):
    raw = series(spark, 60, signals=("search_fever", "search_rash")).withColumn("source_id", F.lit("s"))
    dirty = raw.withColumn("value", F.when(F.pmod(F.xxhash64("date", "district_id"), F.lit(10)) < 2, None).when(F.pmod(F.xxhash64("date", "district_id"), F.lit(10)) < 4, -999.0).otherwise(F.col("value")))
    clean, low = (qu.source_reliability(x).first().reliability for x in (raw, dirty))
    assert clean > 0.85 and low < 0.8
    assert 0 <= qu.quality_report(dirty).agg(F.min("confidence")).first()[0] <= 1


def test_empty_input_gives_empty_output(spark):
    none = spark.createDataFrame([], AGG)
    assert de.run_detectors(none).count() == 0
    assert de.drivers(none).count() == 0
    assert qu.quality_report(spark.createDataFrame([], RAW)).count() == 0
    assert ri.assess_risk(none).count() == 0


def test_latest_prefers_the_higher_risk_on_ties(spark):
    day = datetime.date(2024, 1, 2)
    risk = spark.createDataFrame([("a", day, 10.0), ("a", day, 30.0), ("a", datetime.date(2024, 1, 1), 90.0)], "district_id string, date date, risk_score double")
    assert ri.latest_by_district(risk).first().risk_score == 30.0


def test_alert_rows(spark):
    rows = spark.createDataFrame([("a", "A", datetime.date(2024, 1, 1), 62.5, "Alert", "Vector", "Dengue"), ("b", "B", datetime.date(2024, 1, 1), 3.0, "Normal", "Unknown", "")], "district_id string, district_name string, date date, risk_score double, level string, category string, likely_diseases string")
    got = al.channels(al.actions(al.headline(al.alert_id(al.alert_filter(rows, "Normal"))))).collect()
    assert len(got) == 1 and len(got[0].alert_id) == 12
    assert got[0].headline == "Alert: possible vector outbreak in A (risk 62/100)"
    assert got[0].channels == ["dashboard", "email", "sms"] and len(got[0].actions) == 4


def test_pages(spark):
    latest = spark.createDataFrame([(f"d{i}", float(i % 3)) for i in range(9)], "district_id string, risk_score double")
    assert [r.district_id for r in ro.paged(latest, 2, 3).collect()] == ["d1", "d4"]
    assert ro.paged(latest, None, 7).count() == 2
    with pytest.raises(ValueError):
        ro.paged(latest, 0)


def test_spread_reaches_neighbours_first(spark):
    names = [f"n{i}" for i in range(6)]
    places = spark.createDataFrame([(n, n, "r", 1_000_000, 10.0 + i, 70.0, [names[i + 1]] if i < 5 else []) for i, n in enumerate(names)], "district_id string, name string, region string, population long, lat double, lon double, neighbors array<string>")
    latest = spark.createDataFrame([("n0", 90.0)], "district_id string, risk_score double")
    got = {(r.district_id, r.horizon_days): r.risk_probability for r in gr.spread_forecast(latest, places, gr.gravity_edges(places)).collect()}
    assert got["n1", 7] > got["n2", 7] >= got["n5", 7]
    assert all(got[n, 7] <= got[n, 14] <= got[n, 30] <= 1 for n in names)
    calm = gr.spread_forecast(latest.limit(0), places, gr.gravity_edges(places)).agg(F.max("risk_probability")).first()[0]
    assert calm == 0.0


def test_levers_avert_cases(spark):
    base = (1_000_000, 2.4, 5.0, 6.0, 1.0, 160)
    rows = [("none", *base, 0.0, 0.0, 0.0, 0.0), ("strong", *base, 1.0, 1.0, 1.0, 0.4)]
    got = {r.lever: r for r in pr.scenario_projection(spark.createDataFrame(rows, "lever string, population long, r0 double, incubation_days double, infectious_days double, r0_multiplier double, days int, school_closure double, masking double, travel_restriction double, vaccination_rate double")).collect()}
    assert got["none"].peak_intervention == got["none"].peak_baseline and got["none"].cases_averted == 0
    assert got["strong"].peak_intervention < got["none"].peak_intervention and got["strong"].effective_r < got["none"].effective_r


def test_early_crossing_is_a_miss(spark):
    rows = [(1, d, 50.0 if d >= 2 else 0.0, True, 5) for d in range(10)] + [(2, d, 50.0 if d >= 7 else 0.0, True, 5) for d in range(10)] + [(3, d, 0.0, False, None) for d in range(10)]
    got = po.policy_backtest(spark.createDataFrame(rows, "episode int, day int, risk double, is_outbreak boolean, onset int"), [40]).first()
    assert (got.detection_rate, got.false_alarm_rate, got.mean_delay) == (0.5, 0.0, 2.0)


def test_bundles_without_what_is_needed_give_nothing(spark):
    bad = ['{"entry": [{"resource": {"resourceType": "Patient"}}]}', "not json", None, '{"entry": [{"resource": {"resourceType": "Observation", "code": {"coding": []}, "subject": {"reference": "x/a"}}}]}']
    assert ing.parse_bundles(spark.createDataFrame([(b,) for b in bad], "bundle string")).count() == 0


def test_fill_takes_first_value_before_it(spark):
    day = lambda n: datetime.date(2024, 1, n)
    sparse = spark.createDataFrame([("a", "s", day(3), 5.0), ("a", "s", day(5), 7.0), ("b", "s", day(1), 1.0)], "district_id string, signal_type string, date date, value double")
    got = [r.value for r in ing.fill_daily(sparse).where("district_id = 'a'").orderBy("date").collect()]
    assert got == [5.0, 5.0, 5.0, 5.0, 7.0]


def test_store_replaces_only_touched_regions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "v int, region string"
    assert store.read_table(spark, path, schema).count() == 0
    store.write_table(spark.createDataFrame([(1, "x"), (2, "y")], schema), path)
    store.write_table(spark.createDataFrame([(3, "x")], schema), path)
    assert sorted(r.v for r in store.read_table(spark, path, schema).collect()) == [2, 3]
    store.write_json(spark.createDataFrame([(1, "x")], schema), str(tmp_path / "j"))
    assert store.read_json(spark, str(tmp_path / "j"), schema).first().region == "x"


def test_forest_and_averaging(spark):
    agg = series(spark, 60, signals=de.HOSPITAL, peak=3)
    found = mo.joint_context_iforest(de.trailing_anomalies(agg, de.HOSPITAL))
    assert found.where("context < 0 or context > 1").count() == 0
    late = found.where("district_id = 'a'").orderBy(F.desc("date")).limit(3).agg(F.avg("context")).first()[0]
    assert late > found.where("district_id = 'a'").agg(F.avg("context")).first()[0]
    rows = spark.range(600).select((F.col("id") % 5).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500 - 1).alias("x")).withColumn("y", (F.col("x") > 0.2).cast("double"))
    averaged, pooled = mo.grouped_param_average(rows, "g", ["x"], "y", rounds=5), mo.pooled_logistic(rows, ["x"], "y", rounds=5)
    assert abs(averaged[0] - pooled[0]) < 0.2 and averaged[0] > 0
    assert mo.pooled_logistic(rows.limit(0), ["x"], "y", rounds=2) == [0.0, 0.0]


def test_registered_models_are_fitted_whole(spark, monkeypatch):
    rows = spark.range(50).select(F.lit(0).alias("group"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)) / 100).alias(c) for c in jobs._FEATURES], (F.col("id") % 2).cast("double").alias("y"))
    monkeypatch.setattr(jobs, "_labelled", lambda *_: rows)
    steps = []
    step = mo._stepped
    monkeypatch.setattr(mo, "_stepped", lambda *args: steps.append(1) or step(*args))
    for name in ("grouped_param_average", "pooled_logistic"):
        steps.clear()
        registry.QUERIES[name](spark, "")
        assert len(steps) == 60
    own = inspect.signature(mo.joint_context_iforest).parameters
    assert (own["trees"].default, own["sample"].default) == (120, 256)


def test_novelty_orders_patterns(spark):
    day = datetime.date(2024, 1, 1)
    known = [("known", day, s, 0.7) for s in ("search_fever", "search_rash", "hospital_admissions", "social_mentions")]
    novel = [("novel", day, s, 0.95) for s in ("mortality", "search_diarrhea", "ventilator_usage", "search_rash", "search_cough")]
    quiet = [("quiet", day, "multivariate_context", 0.9)]
    got = {r.district_id: r.novelty for r in mo.novelty_score(spark.createDataFrame(known + novel + quiet, "district_id string, date date, signal_type string, anomaly double")).collect()}
    assert got["known"] < 0.4 < got["novel"] and got["quiet"] == 0.0


def test_districts_of_one_outline_are_paired_without_a_join_of_their_points(spark):
    from watchpost.operators import geo

    square = [(0.0, 0.0), (0.25, 0.0), (0.25, 0.25), (0.0, 0.25)]
    rows = [(f"a{i}", x, y) for i in range(30) for x, y in square] + [(f"b{i}", x + 0.25, y) for i in range(20) for x, y in square] + [("a0", 9.0, None)]
    found = geo.boundary_adjacency(spark.createDataFrame(rows, "district_id string, x double, y double"))
    got = [(r.u, r.v, r.n_shared) for r in found.collect()]
    names = [f"a{i}" for i in range(30)] + [f"b{i}" for i in range(20)]
    want = {(min(u, v), max(u, v)): 4 if u[0] == v[0] else 2 for u in names for v in names if u != v}
    assert len(got) == len(want) and {(u, v): n for u, v, n in got} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "px" not in plan  # pairs of districts are dealt, never counted


def test_equal_rows_are_one_row_of_a_step(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1.0, 1.0)] * 40 + [("b", -1.0, 0.0)] * 20, "g string, x double, y double")
    seen, stepped = [], mo._stepped
    monkeypatch.setattr(mo, "_stepped", lambda held, *rest: seen.append(held.count()) or stepped(held, *rest))
    mo.grouped_param_average(rows, "g", ["x"], "y", rounds=1, epochs=2)
    assert seen == [2, 2]


def test_lines_are_read_once_for_signals_and_confidence(spark, monkeypatch):
    from watchpost.plans import registry
    from watchpost.sources import adapters

    read, names = adapters.read, []
    monkeypatch.setattr(adapters, "read", lambda s, d, name, *c: names.append(name) or read(s, d, name, *c))
    for name in ("confident_risk", "risk_assessment", "novelty_gate"):
        names.clear()
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert names.count("lineitem") == 1
