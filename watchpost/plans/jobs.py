"""Registered queries over ingest, geometry, projections, variants, policies, briefings and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.functions import kernels as ke
from watchpost.functions import scoring as sc
from watchpost.operators import alerts as al
from watchpost.operators import briefing as br
from watchpost.operators import detectors as de
from watchpost.operators import drift as dr
from watchpost.operators import geo
from watchpost.operators import graph as gr
from watchpost.operators import knowledge as kn
from watchpost.operators import models as mo
from watchpost.operators import policy as po
from watchpost.operators import projection as pr
from watchpost.operators import risk as ri
from watchpost.operators import rollups as ro
from watchpost.operators import variants as va
from watchpost.plans.oracle import LEVEL_ORDER, case, listed, rnd, values
from watchpost.plans.registry import SQL, _SPREAD, _agg, _assessed, _risk, _signals, _signals_and_confidence, query
from watchpost.sources import adapters as ad
from watchpost.sources import ingest as ing
from watchpost.sources import registry as re
from watchpost.sources.shared import shared_dir, written
from watchpost.streaming import updates as up

# Ingest

_HOSPITAL_EVENTS = {"click": "hospital_admissions", "view": "icu_occupancy", "signup": "mortality"}


def bundles(spark, d) -> DataFrame:
    """FHIR bundles of the events, one for each customer's nation and day; some observations are no hospital signal."""
    homes = ad.read(spark, d, "customer", "c_custkey", "c_nationkey").join(F.broadcast(ad.places(spark, d)), F.col("c_nationkey") == F.col("nation_key"))
    events = ad.read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").join(homes, F.col("user_id") == F.col("c_custkey"))
    code = F.coalesce(F.create_map(*[F.lit(x) for p in _HOSPITAL_EVENTS.items() for x in p])[F.col("event_type")], F.col("event_type"))
    resource = F.struct(
        F.when(F.col("event_id") % 11 == 0, "Patient").otherwise("Observation").alias("resourceType"),
        F.struct(F.array(F.struct(code.alias("code")), F.struct(F.lit("second").alias("code"))).alias("coding")).alias("code"),
        F.struct(F.concat(F.lit("Location/"), F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("district_id"))).alias("reference")).alias("subject"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("effectiveDateTime"),
        F.when(F.col("event_id") % 17 > 0, F.struct("value")).alias("valueQuantity"),
    )
    grouped = events.groupBy("district_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(resource.alias("resource"))).alias("entry"))
    return grouped.select(F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), "entry")).alias("bundle"))


@query(f"""SELECT district_id, CAST(ts AS DATE) AS date, {case('event_type', _HOSPITAL_EVENTS)} AS signal_type, count(*) AS n, {rnd('sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) / 100.0', 2)} AS total
FROM events JOIN customer ON user_id = c_custkey JOIN places ON c_nationkey = nation_key WHERE event_type IN ({listed(_HOSPITAL_EVENTS)}) AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 > 0 AND value IS NOT NULL GROUP BY 1, 2, 3""", "places")
def fhir_ingest(spark, d):
    rows = ing.parse_bundles(bundles(spark, d))
    return rows.groupBy("district_id", "date", "signal_type").agg(F.count("*").alias("n"), sc.rounded(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")) / 100, 2).alias("total"))


@query("""WITH o AS (SELECT district_id, date, arg_max(value, source_id) AS t, count(*) AS h, max(source_id) AS s FROM daily WHERE signal_type = 'search_fever' GROUP BY district_id, date),
days AS (SELECT o.*, CAST(unnest(generate_series(CAST(date - 2 AS TIMESTAMP), CAST(date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS on_day FROM o)
SELECT district_id, date AS observed, on_day AS date, 'weather_temp' AS signal_type, round(t, 3) AS value FROM days WHERE on_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'
UNION ALL SELECT district_id, date, on_day, 'weather_humidity', round(CAST(h AS DOUBLE), 3) FROM days WHERE h > 1 AND on_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'
UNION ALL SELECT district_id, date, on_day, 'weather_rainfall', CASE WHEN s = 'src2' THEN 12.0 ELSE 0.0 END FROM days WHERE on_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""", "daily")
def weather_unpivot(spark, d):
    seen = ad.daily_signals(spark, d).where("signal_type = 'search_fever'").groupBy("district_id", "date").agg(F.max_by("value", "source_id").alias("temp"), F.count("*").alias("n"), F.max("source_id").alias("s"))
    payload = F.to_json(F.struct(F.struct("temp", F.when(F.col("n") > 1, F.col("n").cast("double")).alias("humidity")).alias("main"), F.when(F.col("s") == "src2", F.struct(F.lit(0.5).alias("1h"))).alias("rain")))
    observed = seen.select(F.concat_ws("@", "district_id", F.col("date").cast("string")).alias("district_id"), "date", payload.alias("payload"))
    day = lambda x: F.lit(x).cast("date")
    rows = ing.unpivot_weather(observed, day("2024-01-03"), day("2024-01-25"))
    key = F.split("district_id", "@")
    return rows.select(key[0].alias("district_id"), key[1].cast("date").alias("observed"), "date", "signal_type", "value")


@query("""WITH sparse AS (SELECT district_id, signal_type, date, value FROM agg WHERE signal_type IN ('search_fever', 'search_rash')), span AS (SELECT min(date) AS a, max(date) AS b FROM sparse),
grid AS (SELECT district_id, signal_type, CAST(day AS DATE) AS date FROM (SELECT DISTINCT district_id, signal_type FROM sparse), (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM span))
SELECT district_id, signal_type, date, floor(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY district_id, signal_type ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (PARTITION BY district_id, signal_type ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * 10000.0 + 0.5) / 10000.0 AS value
FROM grid LEFT JOIN sparse USING (district_id, signal_type, date)""", "agg")
def ffill_daily(spark, d):
    sparse = _agg(spark, d).where("signal_type in ('search_fever', 'search_rash')")
    return ing.fill_daily(sparse).withColumn("value", sc.rounded("value", 4))


@query(f"""WITH series AS (SELECT region, date, signal_type, {rnd('max(value)', 4)} AS value FROM daily WHERE signal_type LIKE 'search_%' GROUP BY region, date, signal_type)
SELECT district_id, date, signal_type, value FROM series JOIN districts USING (region)""", "daily", "districts")
def regional_broadcast(spark, d):
    series = ad.daily_signals(spark, d).where(F.col("signal_type").startswith("search_")).groupBy("region", "date", "signal_type").agg(sc.rounded(F.max("value"), 4).alias("value"))
    return ing.broadcast_regional(series, ad.districts(spark, d))


@query("""SELECT 'events' AS source, 'ok' AS status, (SELECT count(*) FROM daily) AS n_rows UNION ALL SELECT 'orders', 'ok', (SELECT count(*) FROM agg) UNION ALL SELECT 'weather', 'failed', 0""", "daily", "agg")
def source_union(spark, d):
    keep = ["district_id", "date", "signal_type", "value"]
    readers = {"events": lambda: ad.daily_signals(spark, d).select(*keep), "orders": lambda: _agg(spark, d), "weather": lambda: ad.read(spark, d, "weather_stations", *keep)}
    frames, _ = ing.read_sources(readers)
    return ing.source_summary(ing.union_sources(frames), list(readers))


# Geometry: a grid of squares, one for each customer


def features(spark, d) -> DataFrame:
    cells = ad.read(spark, d, "customer", "c_custkey").select(F.concat(F.lit("c"), "c_custkey").alias("district"), (F.col("c_custkey") % 32 * 0.25).alias("x"), (F.floor(F.col("c_custkey") / 32) % 256 * 0.25).alias("y"))
    ring = F.array(*[F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in ((0.0, 0.0), (0.25, 0.0), (0.25, 0.25), (0.0, 0.25), (0.0, 0.0))])
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
    return cells.select(F.to_json(F.struct(F.struct("district").alias("properties"), geometry.alias("geometry"))).alias("feature"))


_SQUARES = "sq AS (SELECT 'c' || c_custkey AS district_id, c_custkey % 32 * CAST(0.25 AS DOUBLE) AS x, floor(c_custkey / 32) % 256 * CAST(0.25 AS DOUBLE) AS y FROM customer)"
_AREA = "CAST(0.0625 AS DOUBLE) * cos(radians((5 * y + 0.5) / 5))"


@query(f"WITH {_SQUARES} SELECT district_id, 0 AS ring, 5 AS n_points, {rnd(_AREA, 6)} AS area, {rnd('x + 0.125', 4)} AS lon, {rnd('y + 0.125', 4)} AS lat FROM sq")
def ring_area(spark, d):
    areas = geo.ring_area(geo.rings(features(spark, d)))
    return areas.select("district_id", "ring", "n_points", *[sc.rounded(c, n).alias(c) for c, n in (("area", 6), ("lon", 4), ("lat", 4))])


@query(f"WITH {_SQUARES} SELECT district_id, {rnd(_AREA, 6)} AS area, greatest(50000, CAST(floor({_AREA} / (SELECT sum({_AREA}) FROM sq) * 300000000 / 1000) AS BIGINT) * 1000) AS population_floor FROM sq")
def derived_districts(spark, d):
    found = geo.derived_districts(geo.ring_area(geo.rings(features(spark, d))), 300_000_000)
    return found.select("district_id", sc.rounded("area", 6).alias("area"), F.greatest(F.lit(50000), (F.floor(F.col("population") / 1000) * 1000).cast("long")).alias("population_floor"))


@query(f"""WITH {_SQUARES}, p AS (SELECT DISTINCT district_id, CAST(floor((x + dx) * 1000 + 0.5) AS BIGINT) AS px, CAST(floor((y + dy) * 1000 + 0.5) AS BIGINT) AS py FROM sq, (VALUES (0.0, 0.0), (0.25, 0.0), (0.25, 0.25), (0.0, 0.25)) c(dx, dy))
SELECT a.district_id AS u, b.district_id AS v, count(*) AS n_shared FROM p a JOIN p b ON a.px = b.px AND a.py = b.py AND a.district_id < b.district_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def boundary_adjacency(spark, d):
    return geo.boundary_adjacency(geo.rings(features(spark, d)))


# Projections

LEVERS = [("none", 0.0, 0.0, 0.0, 0.0), ("mild", 0.3, 0.4, 0.2, 0.1), ("strong", 1.0, 0.9, 0.8, 0.3)]
_LEVER_COLUMNS = "lever string, school_closure double, masking double, travel_restriction double, vaccination_rate double"
_I0 = "greatest(20.0, n * CAST(2e-5 AS DOUBLE))"
_NPI = "(1 - CAST(0.20 AS DOUBLE) * school_closure) * (1 - CAST(0.35 AS DOUBLE) * masking) * (1 - CAST(0.15 AS DOUBLE) * travel_restriction)"


def _run_sql(name: str, mult: str, vacc: str) -> str:
    return f"""{name} AS (SELECT district_id, disease, lever, 0 AS day, n, r0 / infectious_days * {mult} AS beta, 1 / greatest(incubation_days, 0.5) AS sigma, 1 / greatest(infectious_days, 0.5) AS gamma, n - i0 - i0 - {vacc} * (n - i0 - i0) AS s, i0 AS e, i0 AS i FROM sc
    UNION ALL SELECT district_id, disease, lever, day + 1, n, beta, sigma, gamma, greatest(0.0, s - beta * s * i / n), greatest(0.0, e + beta * s * i / n - sigma * e), greatest(0.0, i + sigma * e - gamma * i) FROM {name} WHERE day < 120),
{name}_c AS (SELECT *, {rnd('i', 1)} AS ci FROM {name}), {name}_p AS (SELECT district_id, disease, lever, max(ci) AS peak, arg_max({rnd('s', 1)}, day) AS last_s FROM {name}_c GROUP BY ALL),
{name}_d AS (SELECT c.district_id, c.disease, c.lever, any_value(peak) AS peak, min(day) AS peak_day, any_value(last_s) AS last_s FROM {name}_c c JOIN {name}_p p ON c.district_id = p.district_id AND c.disease = p.disease AND c.lever = p.lever AND ci = peak GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {values('levers', 'lever, school_closure, masking, travel_restriction, vaccination_rate', LEVERS)},
sc AS (SELECT district_id, disease, lever, school_closure, masking, travel_restriction, vaccination_rate, CAST(population AS DOUBLE) AS n, r0, incubation_days, infectious_days, greatest(20.0, CAST(population AS DOUBLE) * CAST(2e-5 AS DOUBLE)) AS i0 FROM districts, disease, levers),
{_run_sql('b', '1.0', '0.0')}, {_run_sql('v', _NPI, 'vaccination_rate')}
SELECT sc.district_id, sc.disease, sc.lever, {rnd(f'r0 * {_NPI} * (1 - vaccination_rate) * (1 - i0 / n)', 3)} AS effective_r, b_d.peak AS peak_baseline, b_d.peak_day AS peak_day_baseline, v_d.peak AS peak_intervention, v_d.peak_day AS peak_day_intervention,
{rnd('greatest(0.0, (n - b_d.last_s) - (n * (1 - vaccination_rate) - v_d.last_s))', 1)} AS cases_averted FROM sc JOIN b_d USING (district_id, disease, lever) JOIN v_d USING (district_id, disease, lever)""", "districts", "know")
def scenario_projection(spark, d):
    grid = ad.districts(spark, d).select("district_id", "population").crossJoin(F.broadcast(kn.diseases(spark).select("disease", "r0", "incubation_days", "infectious_days"))).crossJoin(F.broadcast(spark.createDataFrame(LEVERS, _LEVER_COLUMNS)))
    found = pr.scenario_projection(grid.withColumns({"r0_multiplier": F.lit(1.0), "days": F.lit(120)}))
    return found.select("district_id", "disease", "lever", "effective_r", "peak_baseline", "peak_day_baseline", "peak_intervention", "peak_day_intervention", "cases_averted")


# Variants: return flag and line status stand for the variant of a case

_VARIANT = "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'denv1' WHEN l_returnflag = 'R' THEN 'denv2' WHEN l_linestatus = 'O' THEN 'denvx' ELSE 'denv3' END"
_SHARES = f"""counts AS (SELECT region, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_VARIANT} AS variant, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = nation_key GROUP BY 1, 2, 3),
shares AS (SELECT region, date, variant, n / sum(n) OVER (PARTITION BY region, date) AS share FROM counts)"""
_MIX = f"mix AS (SELECT region, variant, {rnd('arg_max(share, date)', 4)} AS share FROM shares GROUP BY region, variant)"


def _shares(spark, d) -> DataFrame:
    lines = ad.read(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    homes = ad.read(spark, d, "orders", "o_orderkey", "o_custkey").join(ad.read(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(homes, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(ad.places(spark, d)), F.col("c_nationkey") == F.col("nation_key"))
    counts = joined.groupBy("region", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.expr(_VARIANT).alias("variant")).agg(F.count("*").alias("n"))
    return va.variant_shares(counts)


@query(f"WITH {_SHARES} SELECT region, date, variant, {rnd('share', 6)} AS share FROM shares", "places")
def variant_shares(spark, d):
    return _shares(spark, d).withColumn("share", sc.rounded("share", 6))


@query(f"WITH {_SHARES}, {_MIX} SELECT * FROM mix", "places")
def variant_mix(spark, d):
    return va.variant_mix(_shares(spark, d))


@query(f"""WITH {_SHARES}, l AS (SELECT *, lag(share, 59) OVER w AS past, row_number() OVER w AS k, count(*) OVER (PARTITION BY region, variant) AS n FROM shares WINDOW w AS (PARTITION BY region, variant ORDER BY date))
SELECT region, variant, {rnd('share', 4)} AS current_share, {rnd('share - past', 4)} AS slope FROM l WHERE k = n AND n > 60 AND share - past >= 0.01 AND share >= 0.05""", "places")
def emerging_variants(spark, d):
    return va.emerging_variants(_shares(spark, d), slope=0.01, least=0.05)


@query(f"WITH {_SHARES} SELECT region, date, " + ", ".join(f"{rnd(f'max(share) FILTER (WHERE variant = {chr(39)}{v}{chr(39)})', 4)} AS {v}" for v in va.VARIANTS) + " FROM shares GROUP BY region, date", "places")
def variant_series(spark, d):
    return va.variant_series(_shares(spark, d))


@query(f"WITH {_SHARES}, {_MIX}, {values('vm', 'variant, t, s', [(k, *v) for k, v in va.VARIANTS.items()])} SELECT region, {rnd('sum(share * t) / sum(share)', 4)} AS transmissibility, {rnd('sum(share * s) / sum(share)', 4)} AS severity FROM mix JOIN vm USING (variant) GROUP BY region", "places")
def variant_multiplier(spark, d):
    return va.variant_multiplier(va.variant_mix(_shares(spark, d)))


# Policies and accuracy


@query("""WITH w AS (SELECT district_id, date, risk_score, coalesce(risk_score - lag(risk_score, 3) OVER s, 0.0) AS change, coalesce(lag(risk_score, 1) OVER s, 0.0) AS prev FROM risk WINDOW s AS (PARTITION BY district_id ORDER BY date)),
p AS (SELECT district_id, date, CAST(least(9, floor(risk_score / 10)) AS INTEGER) AS bucket, CASE WHEN change < -1 THEN 0 WHEN change < 1 THEN 1 WHEN change < 6 THEN 2 ELSE 3 END AS growth, CAST(risk_score >= 15 AND prev >= 15 AS INTEGER) AS persistent FROM w)
SELECT *, (bucket * 4 + growth) * 2 + persistent AS state FROM p""", "risk")
def alert_state(spark, d):
    return po.alert_state(_risk(spark, d))


_EPISODES = """days AS (SELECT o_custkey AS episode, CAST(datediff('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day, least(100.0, max(o_totalprice) / 5000) AS risk, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1, 2),
onsets AS (SELECT episode, min(day) FILTER (WHERE urgent AND episode % 2 = 0) AS onset FROM days GROUP BY episode), ep AS (SELECT days.*, onset, onset IS NOT NULL AS out FROM days JOIN onsets USING (episode))"""


@query(f"""WITH {_EPISODES}, f AS (SELECT threshold, episode, any_value(out) AS out, any_value(onset) AS onset, min(day) FILTER (WHERE risk >= threshold) AS day FROM ep, (VALUES (20.0), (40.0), (60.0), (80.0)) t(threshold) GROUP BY threshold, episode)
SELECT CAST(threshold AS DOUBLE) AS threshold, {rnd('count(*) FILTER (WHERE out AND day >= onset) / greatest(count(*) FILTER (WHERE out), 1)', 3)} AS detection_rate, {rnd('count(*) FILTER (WHERE NOT out AND day IS NOT NULL) / greatest(count(*) FILTER (WHERE NOT out), 1)', 3)} AS false_alarm_rate, {rnd('coalesce(avg(day - onset) FILTER (WHERE out AND day >= onset), 0.0)', 2)} AS mean_delay FROM f GROUP BY threshold""")
def policy_backtest(spark, d):
    orders = ad.read(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    month = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).alias("day")
    days = orders.groupBy(F.col("o_custkey").alias("episode"), month).agg(F.least(F.lit(100.0), F.max("o_totalprice") / 5000).alias("risk"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    onsets = days.groupBy("episode").agg(F.min(F.when(F.col("urgent") & (F.col("episode") % 2 == 0), F.col("day"))).alias("onset"))
    return po.policy_backtest(days.join(onsets, "episode").withColumn("is_outbreak", F.col("onset").isNotNull()), [20, 40, 60, 80])


@query(f"SELECT l_linestatus, {rnd('avg(CASE WHEN (l_discount * 10 >= 0.5) = (l_returnflag = CHR(82)) THEN 1.0 ELSE 0.0 END)', 6)} AS accuracy FROM lineitem GROUP BY 1")
def binary_accuracy(spark, d):
    lines = ad.read(spark, d, "lineitem", "l_linestatus", "l_discount", "l_returnflag")
    return po.binary_accuracy(lines.select("l_linestatus", (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").alias("y")), ["l_linestatus"])


@query(f"""WITH f AS (SELECT risk_score AS actual, lag(risk_score, 1) OVER w AS a, avg(risk_score) OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b FROM risk WINDOW w AS (PARTITION BY district_id ORDER BY date))
SELECT count(*) AS n, {rnd('avg(abs(a - actual))', 4)} AS mae_a, {rnd('avg(abs(b - actual))', 4)} AS mae_b FROM f WHERE a IS NOT NULL""", "risk")
def forecast_mae(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("district_id").orderBy("date")
    both = _risk(spark, d).select(F.col("risk_score").alias("actual"), F.lag("risk_score", 1).over(w).alias("a"), F.avg("risk_score").over(w.rowsBetween(-4, -1)).alias("b"))
    return po.forecast_mae(both.where("a is not null"))


# Alerts, briefings, detail, knowledge graph


@query(f"""WITH al AS (SELECT *, {LEVEL_ORDER} AS o FROM assessed WHERE {LEVEL_ORDER} >= 1), acts AS (SELECT action, -o AS k1, -risk_score AS k2, district_id, 0 AS pos, date FROM al JOIN level_actions USING (level) UNION ALL SELECT action, -o, -risk_score, district_id, ord + 1, date FROM al JOIN category_actions USING (category))
SELECT action FROM (SELECT action, min(row(k1, k2, district_id, pos)) AS k FROM acts GROUP BY action) ORDER BY k LIMIT 6""", "assessed", "actions")
def distinct_actions(spark, d):
    return al.distinct_actions(al.actions(al.alert_filter(_assessed(spark, d))))


def _briefing(spark, d) -> DataFrame:
    """Briefing contexts from the latest assessment of each district and the outlook, over signals that are written once."""
    places = ad.districts(spark, d)
    assessed = written(ri.latest_by_district(ri.risk_assessment(_signals(spark, d), places)))
    outlook = ro.spread_outlook(gr.spread_forecast(assessed, places, gr.gravity_edges(places)), assessed)
    return br.briefing_context(assessed.join(places.select("district_id", "region"), "district_id"), outlook)


_LATEST = "la AS (SELECT a.*, region FROM assessed a JOIN (SELECT district_id, date FROM latest) USING (district_id, date) JOIN districts USING (district_id))"
_OUTLOOK = "ol AS (SELECT * FROM (SELECT region, district_id, risk_probability AS prob, row_number() OVER (PARTITION BY region ORDER BY risk_probability DESC, district_id) AS rank FROM spread WHERE horizon_days = 30 AND district_id NOT IN (SELECT district_id FROM latest WHERE level <> 'Normal')) WHERE rank <= 4)"
_CONTEXT = f"""{_LATEST}, {_OUTLOOK}, ranked AS (SELECT *, {LEVEL_ORDER} AS o, row_number() OVER (PARTITION BY region ORDER BY risk_score DESC, district_id) AS k FROM la),
shown AS (SELECT * FROM ranked WHERE k <= 5 AND o >= 1), lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY k) AS first FROM shown) WHERE first = 1),
acts AS (SELECT l.region, 0 AS pos, action FROM lead l JOIN level_actions USING (level) UNION ALL SELECT l.region, ord + 1, action FROM lead l JOIN category_actions USING (category) WHERE ord < 2
  UNION ALL SELECT DISTINCT region, 0, '{br.ROUTINE}' FROM ranked WHERE region NOT IN (SELECT region FROM lead)),
ctx AS (SELECT region, max(date) AS as_of, count(*) AS total, count(*) FILTER (WHERE o >= 1) AS on_alert FROM ranked GROUP BY region)"""


@query(f"""WITH {_SPREAD}, {_CONTEXT} SELECT region, as_of, total, on_alert, coalesce((SELECT string_agg(district_name || ' ' || printf('%.0f', risk_score), '; ' ORDER BY k) FROM shown s WHERE s.region = ctx.region), '') AS top,
coalesce((SELECT string_agg(name, '; ' ORDER BY rank) FROM ol JOIN districts USING (district_id) WHERE ol.region = ctx.region), '') AS outlook, (SELECT string_agg(action, '; ' ORDER BY pos) FROM acts WHERE acts.region = ctx.region) AS actions FROM ctx""", "assessed", "latest", "districts", "actions")
def briefing_context(spark, d):
    found = _briefing(spark, d)
    joined = lambda c, f: F.array_join(F.transform(c, f), "; ")
    return found.select("region", "as_of", "total", "on_alert", joined("top", lambda x: F.concat(x["name"], F.lit(" "), x["risk"].cast("string"))).alias("top"), joined("outlook", lambda x: x["name"]).alias("outlook"), F.array_join("actions", "; ").alias("actions"))


@query(f"""WITH {_SPREAD}, {_CONTEXT} SELECT ctx.region, as_of, concat_ws(chr(10), '# ' || ctx.region || ' Health Intelligence Briefing', '_As of ' || strftime(as_of, '%Y-%m-%d') || '_' || chr(10),
'{br.SUMMARY}' || chr(10) || CASE WHEN on_alert = 0 THEN '{br.CALM[0]}' || total || '{br.CALM[1]}'
  ELSE '**' || on_alert || '** of ' || total || '{br.RAISED}' || coalesce((SELECT '{br.HIGHEST}' || district_name || '** (' || level || ', risk ' || printf('%.0f', risk_score) || '/100, likely ' || lower(category) || ').' FROM lead WHERE lead.region = ctx.region), '') END || chr(10),
(SELECT '{br.CONCERN}' || chr(10) || string_agg('- **' || district_name || '** — ' || level || ', risk ' || printf('%.0f', risk_score) || '/100 (' || category || ')' || CASE WHEN likely_diseases <> '' THEN ' — likely: ' || likely_diseases ELSE '' END, chr(10) ORDER BY k) || chr(10) FROM shown WHERE shown.region = ctx.region),
(SELECT '{br.OUTLOOK}' || chr(10) || '{br.AHEAD}' || chr(10) || string_agg('- **' || name || '** — ' || printf('%.0f', prob * 100) || '{br.BY_DAY_30}', chr(10) ORDER BY rank) || chr(10) FROM ol JOIN districts USING (district_id) WHERE ol.region = ctx.region),
(SELECT '{br.ACTIONS}' || chr(10) || string_agg(n || '. ' || action, chr(10) ORDER BY n) || chr(10) FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pos) AS n FROM acts) a WHERE a.region = ctx.region),
'_Generated from statistical surveillance models; it supports expert judgement and does not replace it._') AS body FROM ctx""", "assessed", "latest", "districts", "actions")
def briefing_text(spark, d):
    return br.briefing_text(_briefing(spark, d))


@query(f"""SELECT r.date, r.risk_score, r.level, {rnd('hospital', 4)} AS hospital, {rnd('search', 4)} AS search, {rnd('social', 4)} AS social, {rnd('wastewater', 4)} AS wastewater, l.date AS latest_date FROM risk r JOIN wide w USING (district_id, date) JOIN latest l USING (district_id) WHERE district_id = 'NATION_6'""", "latest")
def district_detail(spark, d):
    own = _agg(spark, d).where("district_id = 'NATION_6'")
    risk, wide = ri.assess_risk(own), de.scores_to_frame(de.run_detectors(own))
    last = ri.latest_by_district(risk).select("district_id", F.col("date").alias("latest_date"))
    return risk.join(wide, ["district_id", "date"]).join(last, "district_id").select("date", "risk_score", "level", *[sc.rounded(c, 4).alias(c) for c in de.DETECTORS], "latest_date")


_KG = values("kg", "src, relation, dst", [(x[0], "presents", f"symptom:{s}") for x in kn.DISEASES for s in x[4]] + [(x[0], "transmitted_by", f"vector:{s}") for x in kn.DISEASES for s in x[3]] + [(x[0], "observed_via", f"signal:{s}") for x in kn.DISEASES for s in x[5]] + [(x[0], "driven_by", f"weather:{s}") for x in kn.DISEASES for s, e in x[6].items() if e == "positive"])


@query(f"WITH {_KG} SELECT src, relation, dst, count(*) AS n_cells FROM kg JOIN drivers ON dst = 'signal:' || signal_type WHERE anomaly > 0.05 GROUP BY ALL", "drivers")
def kg_edges(spark, d):
    seen = de.drivers(_agg(spark, d)).where("anomaly > 0.05").groupBy(F.concat(F.lit("signal:"), "signal_type").alias("dst")).agg(F.count("*").alias("n_cells"))
    return kn.kg_edges(spark).join(seen, "dst").select("src", "relation", "dst", "n_cells")


@query(f"WITH {_KG}, lead AS (SELECT disease FROM matches WHERE rank = 1 GROUP BY disease ORDER BY count(*) DESC, disease LIMIT 1) SELECT DISTINCT dst AS neighbor FROM kg JOIN lead ON src = disease", "matches")
def kg_neighbors(spark, d):
    agg = _signals(spark, d)
    first = kn.match_diseases(de.drivers(agg), kn.weather_state(agg)).where("rank = 1").groupBy("disease").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "disease").limit(1)
    edges = kn.kg_edges(spark).join(F.broadcast(first), F.col("src") == F.col("disease"))
    return edges.select(F.col("dst").alias("neighbor")).distinct()


# Models: rows only, tested by properties


@query()
def joint_context_iforest(spark, d):
    return mo.joint_context_iforest(de.trailing_anomalies(_agg(spark, d), de.HOSPITAL))


@query()
def novelty_score(spark, d):
    return mo.novelty_score(de.drivers(_agg(spark, d)))


@query()
def novel_assessment(spark, d):
    agg, confidence = _signals_and_confidence(spark, d)
    full = ri.full_assessment(agg, ad.districts(spark, d), confidence, mo.novelty_score)
    return full.select("district_id", "date", "risk_score", "level", "confidence", "category", "likely_diseases", "best_match", "novelty_score", "novel", F.size("contributions").alias("n_contributions"))


_FEATURES = ["discount", "tax", "quantity"]


def _labelled(spark, d) -> DataFrame:
    lines = ad.read(spark, d, "lineitem", "l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_suppkey")
    return lines.select((F.col("l_suppkey") % 5).alias("group"), (F.col("l_discount") * 10 - 0.5).alias("discount"), (F.col("l_tax") * 10 - 0.4).alias("tax"), (F.col("l_quantity") / 25 - 1).alias("quantity"), (F.col("l_extendedprice") > 30000).cast("double").alias("y"))


_WEIGHTS = [f"w_{f}" for f in (*_FEATURES, "bias")]
_ROUNDS, _EPOCHS, _RATE = 20, 3, 0.5


def _averaged_sql(group: str) -> str:
    """The same rounds of gradient steps as table expressions, and the accuracy by group of the last mean."""
    z = "0.0 + " + " + ".join(f"{w} * {f}" for w, f in zip(_WEIGHTS, (*_FEATURES, "1.0"), strict=True))
    steps = [f"""rows AS MATERIALIZED (SELECT l_suppkey % 5 AS "group", {group} AS g, l_discount * 10 - CAST(0.5 AS DOUBLE) AS discount, l_tax * 10 - CAST(0.4 AS DOUBLE) AS tax, l_quantity / 25 - 1 AS quantity, CASE WHEN l_extendedprice > 30000 THEN 1.0 ELSE 0.0 END AS y FROM lineitem)""", "m0 AS (SELECT " + ", ".join(f"CAST(0.0 AS DOUBLE) AS {w}" for w in _WEIGHTS) + ")"]
    for r in range(_ROUNDS):
        for e in range(_EPOCHS):
            held = f"rows, m{r}" if e == 0 else f"rows JOIN s{r}_{e - 1} USING (g)"
            moved = ", ".join(f"any_value({w}) - CAST({_RATE} AS DOUBLE) * sum(miss * {f}) / count(*) AS {w}" for w, f in zip(_WEIGHTS, (*_FEATURES, "1.0"), strict=True))
            steps.append(f"s{r}_{e} AS MATERIALIZED (SELECT g, count(*) AS n, {moved} FROM (SELECT g, {', '.join([*_FEATURES, *_WEIGHTS])}, 1 / (1 + exp(-({z}))) - y AS miss FROM {held}) GROUP BY g)")
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT " + ", ".join(f"sum(n * {w}) / sum(n) AS {w}" for w in _WEIGHTS) + f" FROM s{r}_{_EPOCHS - 1})")
    shown = ", ".join(f"any_value({rnd(w, 6)}) AS {w}" for w in _WEIGHTS)
    return f"WITH {', '.join(steps)} SELECT \"group\", {rnd(f'avg(CASE WHEN (1 / (1 + exp(-({z}))) >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)', 6)} AS accuracy, {shown} FROM rows, m{_ROUNDS} GROUP BY 1"


def _accuracy(rows: DataFrame, weights: list[float]) -> DataFrame:
    scored = rows.select("group", mo.logistic_probability(weights, _FEATURES).alias("p"), (F.col("y") == 1).alias("y"))
    return po.binary_accuracy(scored, ["group"]).withColumns({n: sc.rounded(F.lit(w), 6) for n, w in zip(_WEIGHTS, weights, strict=True)})


@query(_averaged_sql("l_suppkey % 5"))
def grouped_param_average(spark, d):
    rows = written(_labelled(spark, d))
    return _accuracy(rows, mo.grouped_param_average(rows, "group", _FEATURES, "y", _ROUNDS, _EPOCHS, _RATE))


@query(_averaged_sql("'all'"))
def pooled_logistic(spark, d):
    rows = written(_labelled(spark, d))
    return _accuracy(rows, mo.pooled_logistic(rows, _FEATURES, "y", _ROUNDS, _EPOCHS, _RATE))


# Robust seasonal decomposition and sources that fail


@query()
def seasonal_decomposition(spark, d):
    agg = ad.weekly_signals(spark, d).select("district_id", "date", "signal_type", "value")
    return ke.stl_residual_z(agg).select("district_id", "date", "signal_type", sc.rounded("season", 4).alias("season"), sc.rounded("z", 4).alias("z"))


@query()
def detect_search_stl(spark, d):
    agg = ad.weekly_signals(spark, d).select("district_id", "date", "signal_type", "value")
    return de.detect_search(agg, ke.stl_residual_z).withColumn("score", sc.rounded("score", 4))


@query("""SELECT 'daily' AS source, 'ok' AS status, (SELECT count(*) FROM daily) AS n_rows, 0 AS n_bad UNION ALL SELECT 'weekly', 'ok', (SELECT count(*) FROM agg), 0
UNION ALL SELECT 'texts', 'ok', (SELECT count(*) FROM agg WHERE signal_type = 'mortality'), (SELECT count(*) FROM agg WHERE signal_type = 'icu_occupancy') UNION ALL SELECT 'down', 'error:ConnectionError: no answer', 0, 0""", "daily", "agg")
def acquired_sources(spark, d):
    """Four sources as jobs of their own: one that is down, one with numbers written as text, some of which are none."""

    def down():
        raise ConnectionError("no answer")

    weekly = lambda: ad.weekly_signals(spark, d)
    spoilt = F.when(F.col("signal_type") == "mortality", F.col("value").cast("string")).otherwise("n/a")
    texts = lambda: weekly().where("signal_type in ('mortality', 'icu_occupancy')").withColumn("value", spoilt)
    return ing.acquire(spark, {"daily": lambda: ad.daily_signals(spark, d), "weekly": weekly, "texts": texts, "down": down})[2]


@query()
def drift_from_daily_sums(spark, d):
    """drift_report from sums of days alone."""
    return dr.drift_from_sums(dr.day_sums(_agg(spark, d)))


SQL["drift_from_daily_sums"] = SQL["drift_report"]


@query("SELECT district_id, signal_type, date, value, count(*) AS n FROM (SELECT district_id, signal_type, date, round(value, 4) AS value FROM daily) WHERE value IS NOT NULL GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY district_id, signal_type, date, value"), "daily")
def daily_value_counts(spark, d):
    return dr.value_counts(ad.daily_signals(spark, d).withColumn("value", F.round("value", 4)))


# Stores, streams and registries over the test tables


@query(f"SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, {rnd('sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) / count(value) / 100', 2)} AS value FROM events GROUP BY 1, 2")
def daily_event_aggregate(spark, d):
    """The streaming aggregate of days, over the whole table at once."""
    cents = ad.read(spark, d, "events", "ts", "event_type", "value").withColumn("value", F.floor(F.col("value") * 100 + 0.5))
    return up.daily_aggregate(cents).withColumn("value", sc.rounded(F.col("value") / 100, 2))


@query(f"WITH o AS (SELECT district_id, date, level, {LEVEL_ORDER} AS o FROM risk), p AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY district_id ORDER BY date), 0) AS b FROM o) SELECT district_id, date, list_extract(['Normal', 'Watch', 'Warning', 'Alert', 'Emergency'], b + 1) AS before, level FROM p WHERE o > b", "risk")
def rising_levels(spark, d):
    return up.rising_levels(_risk(spark, d))


@query("SELECT DISTINCT region, r.district_id, r.date, risk_score, level FROM risk r JOIN agg a ON a.district_id = r.district_id AND a.date = r.date", "risk")
def rescored_risk(spark, d):
    """Risk kept up to date over three micro-batches of signals dealt by a hash of day and series, as late rows are."""
    signals = written(ad.weekly_signals(spark, d).select("region", "district_id", "date", "signal_type", "value"))
    places = signals.select("region", "district_id").distinct()
    score = lambda df: ri.assess_risk(df.select("district_id", "date", "signal_type", "value")).join(places, "district_id").select("region", "district_id", "date", "risk_score", "level")
    scores = up.Scores(spark, shared_dir(spark), score, signals.schema)
    for k in range(3):
        scores.take(signals.where(F.pmod(F.xxhash64("date", "signal_type"), F.lit(3)) == k), k)
    return scores.read()


@query("""WITH y AS (SELECT c_mktsegment AS name, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT name, 'v' || row_number() OVER w AS version, row_number() OVER w AS number, n::DOUBLE AS n_rows, count(*) OVER (PARTITION BY name) AS total_versions FROM y WINDOW w AS (PARTITION BY name ORDER BY y)""")
def model_history(spark, d):
    """A version of each segment's model for every year of orders, registered one after the other, read as history."""
    runs = ad.read(spark, d, "orders", "o_custkey", "o_orderdate").join(ad.read(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    years = runs.groupBy("c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).orderBy("c_mktsegment", "y").collect()  # segments x years
    root = shared_dir(spark)
    for r in years:
        re.register_model(spark, root, r.c_mktsegment, {"n_rows": r.n}, {"year": r.y})
    entries = re.history(spark, root)
    total = re.latest_models(entries).select("name", "total_versions")
    return entries.join(total, "name").select("name", "version", "number", F.col("metrics")["n_rows"].alias("n_rows"), "total_versions")


@query("SELECT region, artifact, arg_max(rows, date) AS rows FROM (SELECT region, signal_type AS artifact, date, count(*) AS rows FROM daily GROUP BY region, signal_type, date) GROUP BY region, artifact", "daily")
def merged_catalog(spark, d):
    """The artifact catalog after merges of the days before and from the middle of the table's last month, as two writers would record them."""
    log = written(ad.daily_signals(spark, d).groupBy("region", F.col("signal_type").alias("artifact"), "date").agg(F.count("*").alias("rows")))
    last = log.agg(F.max("date").alias("_last"))
    halves = log.crossJoin(F.broadcast(last)).withColumn("_new", F.col("date") > F.date_sub("_last", 15))
    catalog = re.Catalog(spark, shared_dir(spark), compact_after=1)
    for new in (False, True):
        own = halves.where(F.col("_new") == new).groupBy("region", "artifact").agg(F.max_by("rows", "date").alias("rows"), F.max("date").cast("timestamp").alias("updated_at"))
        catalog.record(own)
    return catalog.read().select("region", "artifact", "rows")
