"""The whole assessment: confidence, gated contributions, novelty, order of alerts; exact means; sources that fail; region configuration."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from test_operators import AGG, RAW, series

from watchpost.operators import alerts as al
from watchpost.operators import briefing as br
from watchpost.operators import detectors as de
from watchpost.operators import features as fe
from watchpost.operators import graph as gr
from watchpost.operators import models as mo
from watchpost.operators import quality as qu
from watchpost.operators import risk as ri
from watchpost.sources import config
from watchpost.sources import ingest as ing

DAY = datetime.date(2024, 3, 1)
PLACES = "district_id string, name string, region string, population long, lat double, lon double, neighbors array<string>"


@pytest.fixture(scope="module")
def signals(spark):
    return series(spark, 90, signals=(*de.SEARCH, *de.HOSPITAL, "social_mentions", "wastewater_viral_load", "weather_rainfall"), peak=6)


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([("a", "Alpha", "r", 1000, 10.0, 70.0, ["b"])], PLACES)


def test_scores_wide_equals_the_detectors(signals):
    one = de.scores_wide(de.all_anomalies(signals))
    many = de.scores_to_frame(de.run_detectors(signals))
    both = one.alias("o").join(many.alias("m"), ["district_id", "date"])
    far = [F.abs(F.col(f"o.{d}") - F.col(f"m.{d}")) > 1e-12 for d in de.DETECTORS]
    assert both.count() == one.count() == many.count() == 180
    assert both.where(far[0] | far[1] | far[2] | far[3]).count() == 0
    few = signals.where("signal_type = 'social_mentions'")
    assert [r for r in de.scores_wide(de.all_anomalies(few)).where("search is not null or hospital is not null or wastewater is not null or social is null").collect()] == []


def test_confidence_tempers_the_assessment(spark, signals, places):
    confidence = signals.select("district_id", "date").distinct().where("district_id = 'a'").withColumn("confidence", F.lit(0.5))
    full = ri.full_assessment(signals, places, confidence).cache()
    plain = ri.risk_assessment(signals, places)
    both = full.alias("f").join(plain.alias("p"), ["district_id", "date"])
    assert both.where("f.district_id = 'b' and f.risk_score <> p.risk_score").count() == 0
    assert both.where("f.district_id = 'a' and abs(f.risk_score - p.risk_score * 0.85) > 0.011").count() == 0
    assert {(r.district_id, r.confidence) for r in full.select("district_id", "confidence").distinct().collect()} == {("a", 0.5), ("b", 1.0)}
    top = full.orderBy(F.desc("risk_score")).first()
    assert top.level != "Normal" and len(top.contributions) >= 3 and top.district_name == "Alpha"
    assert full.where("level = 'Normal' and size(contributions) > 0").count() == 0
    wild = ri.risk_score(de.scores_wide(de.all_anomalies(signals)), confidence.withColumn("confidence", F.lit(7.0)))
    assert wild.agg(F.max("risk_score")).first()[0] <= 100
    full.unpersist()


def test_novelty_runs_through_the_assessment(spark, signals, places):
    confidence = spark.createDataFrame([], "district_id string, date date, confidence double")
    new = lambda rows: rows.select("district_id", "date").distinct().withColumn("novelty", F.lit(0.9))
    got = ri.full_assessment(signals, places, confidence, new).cache()
    assert got.where("level = 'Normal' and (novelty_score > 0 or novel)").count() == 0
    assert got.where("novel and (category <> 'Unknown' or likely_diseases <> '' or risk_score < 55 or best_match >= 0.85)").count() == 0
    assert got.where("risk_score >= 55 and best_match < 0.85 and not novel and novelty_score >= 0.6").count() == 0
    trained = ri.full_assessment(signals, places, confidence, mo.novelty_score)
    assert trained.where("novelty_score < 0 or novelty_score > 1 or novelty_score is null").count() == 0
    got.unpersist()


def test_alerts_come_most_severe_first(spark):
    rows = [("a", DAY, 80.0, "Emergency"), ("b", DAY, 99.0, "Alert"), ("c", DAY, 60.0, "Alert"), ("d", DAY, 60.0, "Alert"), ("e", DAY, 5.0, "Normal"), ("f", DAY, 90.0, "Watch")]
    assessed = spark.createDataFrame(rows, "district_id string, date date, risk_score double, level string")
    got = al.ranked(al.alert_filter(assessed)).orderBy("rank").collect()
    assert [(r.rank, r.district_id) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "f")]


def test_weighted_mean_is_exact_in_any_order(spark):
    rows = [("a", DAY, "x", v, f"s{i % 3}") for i, v in enumerate([0.1, 0.2, 0.3, 1e9, -1e9, 0.7, None, float("nan"), float("inf"), 12.345678])]
    weights = spark.createDataFrame([("s0", 0.9), ("s1", 0.0)], "source_id string, reliability double")
    means = {fe.weighted_source_mean(spark.createDataFrame(rows[k:] + rows[:k], RAW).repartition(3), weights).first().value for k in range(4)}
    w = [{0: 0.9, 1: 0.001, 2: 1.0}[i % 3] for i in range(10)]
    kept = [i for i in range(10) if i not in (6, 7, 8)]
    assert means == {sum(round(w[i] * 10000) * round(rows[i][3] * 10**8) for i in kept) / 10**12 / (sum(round(x * 10000) for x in w) / 10000)}


def test_daily_confidence_is_held_to_the_report(spark):
    raw = series(spark, 40, signals=("social_mentions", "search_fever")).withColumn("source_id", F.lit("s"))
    assert raw.columns == [*AGG.replace(",", "").split()[::2], "source_id"]
    a = qu.daily_confidence(raw).select("district_id", "date", "confidence")
    b = qu.quality_report(raw).select("district_id", "date", "confidence")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()


def test_failed_sources_leave_the_others(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    readers = {"good": lambda: spark.read.parquet(str(tmp_path / "good")), "gone": lambda: spark.read.parquet(str(tmp_path / "gone")), "odd": lambda: spark.read.parquet(str(tmp_path / "good")).select("nothing")}
    frames, status = ing.read_sources(readers)
    assert list(frames) == ["good"] and status["good"] == "ok" and status["gone"].startswith("error:PATH_NOT_FOUND") and status["odd"].startswith("error:UNRESOLVED_COLUMN")
    got = {r.source: (r.status, r.n_rows) for r in ing.source_summary(ing.union_sources(frames), list(readers)).collect()}
    assert got == {"good": ("ok", 3), "gone": ("failed", 0), "odd": ("failed", 0)}


def test_region_configuration(spark, tmp_path):
    listed = {"region": "r1", "name": "First", "districts": [{"id": "a", "name": "Alpha", "population": 5, "lat": 1.0, "lon": 2.0, "neighbors": ["b", "zz"]}, {"name": "Beta Town!", "neighbors": None}]}
    derived = {"region": "r2", "geojson": "r2.json", "total_population": 1_000_000}
    (tmp_path / "regions.json").write_text("\n".join(map(json.dumps, (listed, derived))))
    regions = config.read_regions(spark, str(tmp_path / "regions.json"))
    assert [tuple(r) for r in config.region_dim(regions).orderBy("region").collect()] == [("r1", "First", None, 2), ("r2", "r2", "r2.json", None)]
    districts = config.district_dim(regions)
    assert [(r.district_id, r.name, r.population, r.neighbors) for r in districts.orderBy("district_id").collect()] == [("a", "Alpha", 5, ["b", "zz"]), ("beta_town", "Beta Town!", 0, [])]
    assert sorted(r.neighbor for r in config.dangling_neighbors(districts).collect()) == ["b", "zz"]
    square = lambda x: [[[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]]]
    shapes = [("r2", json.dumps({"properties": {"district": n}, "geometry": {"type": "MultiPolygon", "coordinates": square(x)}})) for n, x in (("p", 0.0), ("q", 1.0))]
    got = {r.district_id: r for r in config.derived_dim(regions, spark.createDataFrame(shapes, "region string, feature string")).collect()}
    assert got["p"].neighbors == ["q"] and got["q"].neighbors == ["p"] and all(abs(r.population - 500_000) <= 1 for r in got.values())


def test_briefing_lists_its_sources(spark):
    rows = [("r", "a", "Alpha", DAY, 60.0, "Alert", "Vector", "Dengue"), ("q", "b", "Beta", DAY, 3.0, "Normal", "Unknown", "")]
    assessed = spark.createDataFrame(rows, "region string, district_id string, district_name string, date date, risk_score double, level string, category string, likely_diseases string")
    outlook = spark.createDataFrame([("q", "b", 0.25, 1)], "region string, district_id string, prob double, rank int")
    context = br.briefing_context(assessed, outlook)
    sources = F.create_map(F.lit("search"), F.lit("ok"), F.lit("events"), F.lit("error:PATH_NOT_FOUND"))
    got = {r.region: r.body for r in br.briefing_text(context.withColumn("data_sources", sources)).collect()}
    assert "## Data Sources\nevents (error:PATH_NOT_FOUND), search (ok)\n" in got["r"] and br.AHEAD not in got["r"]
    assert f"{br.OUTLOOK}\n{br.AHEAD}\n- **Beta** — 25% probability by day 30\n" in got["q"] and br.CONCERN not in got["q"]
    assert br.SOURCES not in br.briefing_text(context).where("region = 'r'").first().body


def test_spread_of_a_star(spark):
    places = spark.createDataFrame([(n, n, "r", 1000, 10.0 + i / 10, 70.0, ["hub"]) for i, n in enumerate(["hub", "x", "y", "z", "alone"])], PLACES).withColumn("neighbors", F.when(F.col("district_id") == "alone", F.array().cast("array<string>")).otherwise(F.col("neighbors")))
    edges = gr.gravity_edges(places)
    weight = {frozenset((r.u, r.v)): r.weight for r in edges.collect()}
    p = {"hub": 0.4, "x": 0.0, "y": 0.2, "z": 0.0, "alone": 0.3}
    latest = spark.createDataFrame([(k, v * 100) for k, v in p.items() if v], "district_id string, risk_score double")
    got = {(r.district_id, r.horizon_days): r.risk_probability for r in gr.spread_forecast(latest, places, edges).collect()}
    for day in range(1, 31):
        p = {n: min(1.0, v + (1 - v) * (0.04 * v + 0.085 * sum(weight.get(frozenset((n, o)), 0.0) * p[o] for o in p if o != n))) for n, v in p.items()}
        if day in gr.HORIZONS:
            assert all(got[n, day] == pytest.approx(v, abs=1e-4) for n, v in p.items())


def test_sources_that_fail_leave_the_others_alone(spark):
    rows = [("a", DAY, "mortality", 1.5), ("a", DAY, "icu_occupancy", None)]
    good = lambda: spark.createDataFrame(rows, "district_id string, date date, signal_type string, value double")
    texts = lambda: spark.createDataFrame([("b", "2024-03-01", "mortality", "2.5", "own"), ("b", "no day", "mortality", "1", "own"), (None, "2024-03-01", "mortality", "1", "own"), ("b", "2024-03-02", "mortality", "many", "own")], "district_id string, date string, signal_type string, value string, source_id string")

    def raises():
        raise OSError("no route to host")

    def dies():
        def some(batches):
            for k, batch in enumerate(batches):
                if k == 0 and batch.num_rows and batch.column(0)[0].as_py() == "z":
                    raise RuntimeError("the line broke")
                yield batch

        df = spark.createDataFrame([("y", DAY, "mortality", 1.0, "s")] * 50 + [("z", DAY, "mortality", 1.0, "s")], ing.SIGNALS)
        return df.coalesce(1).repartitionByRange(2, "district_id").mapInArrow(some, ing.SIGNALS)

    readers = {"good": good, "texts": texts, "raises": raises, "dies": dies, "gone": lambda: spark.read.parquet("/tmp/no/such/table"), "narrow": lambda: good().drop("value"), "empty": lambda: good().limit(0)}
    signals, bad, summary = ing.acquire(spark, readers)
    told = {r.source: (r.status, r.n_rows, r.n_bad) for r in summary.collect()}
    assert told["good"] == ("ok", 2, 0) and told["texts"] == ("ok", 1, 3) and told["empty"] == ("ok", 0, 0)
    assert told["raises"] == ("error:OSError: no route to host", 0, 0) and told["narrow"] == ("error:no column value", 0, 0)
    assert told["gone"] == ("error:PATH_NOT_FOUND", 0, 0) and told["dies"][0].startswith("error:") and told["dies"][1:] == (0, 0)
    assert sorted(map(tuple, signals.collect()), key=str) == sorted([("a", DAY, "mortality", 1.5, "good"), ("a", DAY, "icu_occupancy", None, "good"), ("b", DAY, "mortality", 2.5, "own")], key=str)
    assert sorted(json.loads(r.record).get("value") for r in bad.collect()) == ["1", "1", "many"]
    assert ing.read_sources({"raises": raises, "good": good})[1] == {"raises": "error:OSError: no route to host", "good": "ok"}
    assert [x.count() for x in ing.acquire(spark, {})] == [0, 0, 0]


def test_any_number_of_regions_is_one_plan(spark):
    """Regions of two squares each: every region equals itself alone, and the plan's size doesn't depend on their number."""
    square = lambda name, x, y: json.dumps({"properties": {"district": name}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]]}})
    n = 1000
    regions = spark.createDataFrame([(f"r{k}", None, "x.json", 1_000_000 + k, None) for k in range(n)] + [("listed", None, None, 5, [("d", "D", None, 1, 0.0, 0.0, None)])], config.REGION)
    # Districts of all regions have the same names and, in pairs of regions, the same places.
    shapes = spark.createDataFrame([(f"r{k}", square(d, k // 2 % 40 + dx, 10.0)) for k in range(n) for d, dx in (("a", 0.0), ("b", 1.0))] + [("listed", square("a", 0.0, 0.0)), ("unknown", square("a", 0.0, 0.0))], "region string, feature string")
    df = config.derived_dim(regions, shapes)
    got = df.collect()
    assert len(got) == 2 * n and {r.region for r in got} == {f"r{k}" for k in range(n)}
    assert all(r.neighbors == [{"a": "b", "b": "a"}[r.district_id]] for r in got)
    assert all(abs(r.population - (1_000_000 + int(r.region[1:])) / 2) <= 1 for r in got)
    alone = config.derived_dim(regions.where("region = 'r7'"), shapes).collect()
    assert sorted(alone) == sorted(r for r in got if r.region == "r7")
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert size(df) < 1.2 * size(config.derived_dim(regions.where("region = 'r7'"), shapes)) + 2000
    assert config.derived_dim(regions.where("region = 'listed'"), shapes).count() == 0


def test_steps_of_few_groups_shuffle_no_rows(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 11 / 11.0).alias("b"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    plans, step = [], mo._stepped
    monkeypatch.setattr(mo, "_stepped", lambda held, names, rate: plans.append(held) or step(held, names, rate))
    few = mo.grouped_param_average(rows, "g", ["a", "b"], "y", rounds=2)
    assert all("Exchange hashpartitioning" not in p._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0] for p in plans)
    monkeypatch.setattr(mo, "FEW_GROUPS", 2)
    many = mo.grouped_param_average(rows, "g", ["a", "b"], "y", rounds=2)
    assert few == pytest.approx(many, rel=1e-12)
