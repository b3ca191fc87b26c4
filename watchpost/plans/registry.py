"""Registered queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.functions import scoring as sc
from watchpost.functions import stats as st
from watchpost.operators import alerts as al
from watchpost.operators import detectors as de
from watchpost.operators import features as fe
from watchpost.operators import graph as gr
from watchpost.operators import knowledge as kn
from watchpost.operators import quality as qu
from watchpost.operators import risk as ri
from watchpost.operators import rollups as ro
from watchpost.plans.oracle import LEVEL_ORDER, anomaly, build, level, listed, rnd, tempered
from watchpost.sources import adapters as ad
from watchpost.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str, name: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = build(sql, *needs)
        return f

    return register


def _agg(spark, d) -> DataFrame:
    return ad.weekly_signals(spark, d).select("district_id", "date", "signal_type", "value")


def _signals(spark, d) -> DataFrame:
    """The same, written once: for queries that go through it more than once."""
    return written(_agg(spark, d))


def _risk(spark, d) -> DataFrame:
    return ri.assess_risk(_agg(spark, d))


def _latest(spark, d) -> DataFrame:
    """The latest risk of each district, with its name and region."""
    places = ad.districts(spark, d)
    return ri.named(ri.latest_by_district(_risk(spark, d)), places).join(places.select("district_id", "region"), "district_id", "left")


def _assessed(spark, d) -> DataFrame:
    return ri.risk_assessment(_signals(spark, d), ad.districts(spark, d))


# Scans and scalar rules


@query("SELECT district_id, date, signal_type, round(value, 4) AS value, source_id FROM daily WHERE region = 'ASIA'", "daily")
def scan_signals(spark, d):
    return ad.daily_signals(spark, d).where("region = 'ASIA'").select("district_id", "date", "signal_type", F.round("value", 4).alias("value"), "source_id")


@query("SELECT district_id, date, risk_score FROM risk WHERE risk_score > 0", "risk")
def scan_risk(spark, d):
    return _risk(spark, d).where("risk_score > 0").select("district_id", "date", "risk_score")


@query(f"SELECT district_id, date, signal_type, {rnd(anomaly('z'), 4)} AS anomaly FROM z", "z")
def anomaly_from_z(spark, d):
    return st.rolling_robust_z(_agg(spark, d)).select("district_id", "date", "signal_type", sc.rounded(sc.anomaly_from_z("z"), 4).alias("anomaly"))


@query(f"SELECT district_id, date, level, {LEVEL_ORDER} AS level_order FROM risk", "risk")
def risk_level(spark, d):
    return _risk(spark, d).select("district_id", "date", "level", sc.level_order("level").alias("level_order"))


@query("SELECT DISTINCT c_mktsegment AS raw, trim(regexp_replace(lower(trim('  ' || c_mktsegment || ' & Co. (' || c_nationkey || ')')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def slugify(spark, d):
    names = ad.read(spark, d, "customer", "c_mktsegment", "c_nationkey")
    return names.select(F.col("c_mktsegment").alias("raw"), sc.slug(F.concat(F.lit("  "), "c_mktsegment", F.lit(" & Co. ("), F.col("c_nationkey").cast("string"), F.lit(")"))).alias("slug")).distinct()


@query(f"""SELECT l_orderkey, l_linenumber, {rnd("(1 - CAST(0.20 AS DOUBLE) * greatest(0.0, least(1.0, l_discount * 15))) * (1 - CAST(0.35 AS DOUBLE) * greatest(0.0, least(1.0, l_tax * 10))) * (1 - CAST(0.15 AS DOUBLE) * greatest(0.0, least(1.0, l_quantity / 40 - 0.1)))", 6)} AS multiplier FROM lineitem""")
def npi_multiplier(spark, d):
    lines = ad.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return lines.select("l_orderkey", "l_linenumber", sc.rounded(sc.transmission_multiplier(F.col("l_discount") * 15, F.col("l_tax") * 10, F.col("l_quantity") / 40 - 0.1), 6).alias("multiplier"))


@query(f"SELECT date, {rnd('value', 4)} AS value FROM agg WHERE district_id = 'NATION_7' AND signal_type = 'search_fever'", "agg")
def district_series(spark, d):
    return fe.district_series(_agg(spark, d), "NATION_7", "search_fever").select("date", sc.rounded("value", 4).alias("value"))


@query("SELECT district_id, date, driver, state FROM weather", "weather")
def weather_state(spark, d):
    return kn.weather_state(_agg(spark, d))


# Features and windows


@query(f"""WITH w AS (SELECT *, CASE source_id WHEN 'src0' THEN CAST(0.9 AS DOUBLE) WHEN 'src1' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS w FROM daily)
SELECT district_id, date, signal_type, {rnd('coalesce(CAST(sum(CAST(w AS DECIMAL(5, 4)) * CAST(value AS DECIMAL(28, 8))) AS DOUBLE), 0.0) / CAST(sum(CAST(w AS DECIMAL(5, 4))) AS DOUBLE)', 4)} AS value FROM w GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY district_id, date, signal_type"), "daily")
def weighted_source_mean(spark, d):
    weights = spark.createDataFrame([("src0", 0.9), ("src1", 0.5)], "source_id string, reliability double")
    return fe.weighted_source_mean(ad.daily_signals(spark, d), weights).withColumn("value", sc.rounded("value", 4))


@query("SELECT district_id, date, " + ", ".join(f"{rnd(f'avg(value) FILTER (WHERE signal_type = {chr(39)}{t}{chr(39)})', 4)} AS {t}" for t in fe.SIGNAL_TYPES) + " FROM agg GROUP BY district_id, date", "agg")
def pivot_signals(spark, d):
    wide = fe.pivot_signals(_agg(spark, d))
    return wide.select("district_id", "date", *[sc.rounded(t, 4).alias(t) for t in fe.SIGNAL_TYPES])


@query(f"SELECT district_id, date, signal_type, {rnd('z', 4)} AS z FROM z", "z")
def rolling_robust_z(spark, d):
    return st.rolling_robust_z(_agg(spark, d)).select("district_id", "date", "signal_type", sc.rounded("z", 4).alias("z"))


@query(f"SELECT district_id, date, signal_type, {rnd('z', 4)} AS z FROM seasonal", "seasonal")
def deseasonal_z(spark, d):
    z = st.deseasonal_z(_agg(spark, d).where(F.col("signal_type").startswith("search_")))
    return z.select("district_id", "date", "signal_type", sc.rounded("z", 4).alias("z"))


@query(f"SELECT district_id, date, signal_type, {rnd('baseline', 4)} AS baseline, {rnd('pct', 2)} AS pct FROM pct", "pct")
def pct_vs_baseline(spark, d):
    return st.pct_vs_baseline(_agg(spark, d)).select("district_id", "date", "signal_type", sc.rounded("baseline", 4).alias("baseline"), sc.rounded("pct", 2).alias("pct"))


@query(f"SELECT district_id, date, {rnd('score', 4)} AS score FROM top2", "top2")
def corroborated_top2(spark, d):
    return de.corroborated_top2(de.search_anomalies(_agg(spark, d))).withColumn("score", sc.rounded("score", 4))


@query("SELECT district_id, date, risk_score, level FROM latest", "latest")
def latest_by_district(spark, d):
    return ri.latest_by_district(_risk(spark, d))


@query("SELECT region, district_id, population FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY population DESC, district_id) AS k, count(*) OVER (PARTITION BY region) AS n FROM districts) WHERE k = least(3, n)", "districts")
def population_rank(spark, d):
    return ro.population_rank(ad.districts(spark, d), 3)


# Detectors

for _name, _detect in (("search", de.detect_search), ("hospital", de.detect_hospital), ("social", de.detect_social), ("wastewater", de.detect_wastewater)):

    def _one(spark, d, detect=_detect):
        return detect(_agg(spark, d)).withColumn("score", sc.rounded("score", 4))

    query(f"SELECT district_id, date, detector, {rnd('score', 4)} AS score FROM scores WHERE detector = '{_name}'", "scores", name=f"detect_{_name}")(_one)


@query(f"SELECT district_id, date, {rnd('context', 4)} AS context FROM context", "context")
def joint_context(spark, d):
    return de.joint_context(de.trailing_anomalies(_agg(spark, d), de.HOSPITAL)).withColumn("context", sc.rounded("context", 4))


@query("SELECT district_id, date, " + ", ".join(f"{rnd(c, 4)} AS {c}" for c in de.DETECTORS) + " FROM wide", "wide")
def detector_scores_wide(spark, d):
    wide = de.scores_to_frame(de.run_detectors(_agg(spark, d)))
    return wide.select("district_id", "date", *[sc.rounded(c, 4).alias(c) for c in de.DETECTORS])


@query("SELECT district_id, date, signal_type, anomaly FROM drivers", "drivers")
def driver_max(spark, d):
    return de.drivers(_agg(spark, d))


# Quality, on daily signals with sources

_QUALITY = f"""series AS (SELECT source_id, district_id, signal_type, least(1.0, count(value) / (SELECT count(DISTINCT date) FROM daily)) AS completeness, avg(CASE WHEN value IS NULL OR value < 0 OR (signal_type LIKE 'search_%' AND value > 100) THEN 0.0 ELSE 1.0 END) AS integrity FROM daily GROUP BY source_id, district_id, signal_type),
gaps AS (SELECT *, value - quantile_cont(value, 0.5) OVER (PARTITION BY source_id, district_id, signal_type ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS gap FROM daily),
stable AS (SELECT source_id, district_id, signal_type, CASE WHEN count(*) < 8 THEN 1.0 ELSE 1 / (1 + stddev_pop(gap) / greatest(abs(avg(value)), CAST(1e-6 AS DOUBLE))) END AS stability FROM gaps GROUP BY source_id, district_id, signal_type),
means AS (SELECT source_id, avg(completeness) AS c, avg(integrity) AS i, avg(stability) AS s FROM series JOIN stable USING (source_id, district_id, signal_type) GROUP BY source_id),
reliability AS (SELECT source_id, {rnd('CAST(0.5 AS DOUBLE) * c + CAST(0.2 AS DOUBLE) * i + CAST(0.3 AS DOUBLE) * s', 4)} AS reliability, {rnd('c', 4)} AS completeness, {rnd('i', 4)} AS integrity, {rnd('s', 4)} AS stability, concat_ws('; ', CASE WHEN c < 0.9 THEN 'incomplete' END, CASE WHEN i < 0.99 THEN 'implausible values' END, CASE WHEN s < 0.7 THEN 'unstable' END) AS notes FROM means)"""
_MISSING = "missing AS (SELECT district_id, date, greatest(0.0, 1 - count(DISTINCT signal_type) / (SELECT count(DISTINCT signal_type) FROM daily)) AS missing_ratio FROM daily GROUP BY district_id, date)"
_OUTLIER = """g AS (SELECT district_id, date, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM daily GROUP BY district_id, date),
o AS (SELECT district_id, date, source_id, signal_type, value, value - med AS dev, sd FROM daily JOIN g USING (district_id, date)),
m AS (SELECT district_id, date, quantile_cont(abs(dev), 0.5) AS mad FROM o GROUP BY district_id, date),
rz AS (SELECT o.*, CASE WHEN mad > 0 THEN CAST(0.6745 AS DOUBLE) * dev / mad WHEN sd > 0 THEN dev / sd ELSE 0.0 END AS rz FROM o JOIN m USING (district_id, date)),
outliers AS (SELECT district_id, date, avg(CASE WHEN abs(rz) > 6 THEN 1.0 ELSE 0.0 END) AS outlier_ratio FROM rz GROUP BY district_id, date)"""


def psi_sql(source: str, keys: str, name: str) -> str:
    """Table expressions for PSI of `value` by `recent`, the same steps as the operator's."""
    return f"""{name}_e AS (SELECT {keys}, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM {source} WHERE NOT recent GROUP BY {keys}),
{name}_b AS (SELECT {keys}, len(list_filter(edges, lambda e: e <= value)) AS bin, count(*) FILTER (WHERE NOT recent) AS b, count(*) FILTER (WHERE recent) AS r FROM {source} JOIN {name}_e USING ({keys}) GROUP BY {keys}, bin),
{name}_s AS (SELECT *, sum(b) OVER (PARTITION BY {keys}) AS nb, sum(r) OVER (PARTITION BY {keys}) AS nr FROM {name}_b),
{name} AS (SELECT {keys}, CASE WHEN min(nb) < 10 OR min(nr) < 10 THEN 0.0 ELSE sum((greatest(r / nr, CAST(1e-6 AS DOUBLE)) - greatest(b / nb, CAST(1e-6 AS DOUBLE))) * ln(greatest(r / nr, CAST(1e-6 AS DOUBLE)) / greatest(b / nb, CAST(1e-6 AS DOUBLE)))) END AS psi FROM {name}_s GROUP BY {keys})"""


_DRIFT = """split AS (SELECT *, k > floor(n * 0.75) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY district_id, signal_type ORDER BY date, source_id) AS k, count(*) OVER (PARTITION BY district_id, signal_type) AS n FROM daily) WHERE n >= 20),
""" + psi_sql("split", "district_id, signal_type", "p") + """,
drift AS (SELECT d.district_id, coalesce(avg(psi), 0.0) AS drift_score FROM (SELECT DISTINCT district_id FROM daily) d LEFT JOIN p USING (district_id) GROUP BY d.district_id)"""
_REPORT = f"report AS (SELECT district_id, date, {rnd('greatest(0.0, least(1.0, (SELECT avg(reliability) FROM reliability) * (1 - CAST(0.6 AS DOUBLE) * missing_ratio) * (1 - CAST(0.3 AS DOUBLE) * outlier_ratio)))', 4)} AS confidence, {rnd('missing_ratio', 4)} AS missing_ratio, {rnd('outlier_ratio', 4)} AS outlier_ratio, {rnd('drift_score', 4)} AS drift_score FROM missing JOIN outliers USING (district_id, date) JOIN drift USING (district_id))"


@query(f"WITH {_QUALITY} SELECT source_id, district_id, signal_type, {rnd('completeness', 6)} AS completeness FROM series", "daily")
def completeness(spark, d):
    return qu.completeness(ad.daily_signals(spark, d)).withColumn("completeness", sc.rounded("completeness", 6))


@query(f"WITH {_QUALITY} SELECT source_id, district_id, signal_type, {rnd('stability', 4)} AS stability FROM stable", "daily")
def series_stability(spark, d):
    return qu.series_stability(ad.daily_signals(spark, d)).withColumn("stability", sc.rounded("stability", 4))


@query(f"WITH {_QUALITY} SELECT * FROM reliability", "daily")
def source_reliability(spark, d):
    return qu.source_reliability(ad.daily_signals(spark, d))


@query(f"WITH {_OUTLIER} SELECT district_id, date, source_id, signal_type, {rnd('rz', 4)} AS rz FROM rz", "daily")
def robust_z(spark, d):
    return st.group_robust_z(ad.daily_signals(spark, d), ["district_id", "date"]).select("district_id", "date", "source_id", "signal_type", sc.rounded("rz", 4).alias("rz"))


@query(f"WITH {_OUTLIER} SELECT district_id, date, {rnd('outlier_ratio', 4)} AS outlier_ratio FROM outliers", "daily")
def outlier_ratio(spark, d):
    return qu.outlier_ratio(ad.daily_signals(spark, d)).withColumn("outlier_ratio", sc.rounded("outlier_ratio", 4))


@query(f"WITH {_MISSING} SELECT district_id, date, {rnd('missing_ratio', 4)} AS missing_ratio FROM missing", "daily")
def missing_ratio(spark, d):
    return qu.missing_ratio(ad.daily_signals(spark, d)).withColumn("missing_ratio", sc.rounded("missing_ratio", 4))


@query(f"WITH {_QUALITY}, {_MISSING}, {_OUTLIER}, {_DRIFT}, {_REPORT} SELECT * FROM report", "daily")
def quality_report(spark, d):
    return qu.quality_report(ad.daily_signals(spark, d))


@query(f"WITH {_QUALITY}, {_MISSING}, {_OUTLIER}, {_DRIFT}, {_REPORT} SELECT district_id, arg_max(confidence, date) AS confidence FROM report GROUP BY district_id", "daily")
def latest_confidence(spark, d):
    return qu.latest_confidence(qu.quality_report(ad.daily_signals(spark, d)))


@query(f"WITH {_DRIFT} SELECT district_id, {rnd('drift_score', 4)} AS drift_score FROM drift", "daily")
def district_drift(spark, d):
    return qu.district_drift(ad.daily_signals(spark, d)).withColumn("drift_score", sc.rounded("drift_score", 4))


_SPLIT5 = f"means AS (SELECT signal_type, date, {rnd('avg(value)', 6)} AS value FROM agg GROUP BY signal_type, date), split AS (SELECT *, k > floor(n * 0.8) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY date) AS k, count(*) OVER (PARTITION BY signal_type) AS n FROM means) WHERE n >= 30), "


@query(f"WITH {_SPLIT5}{psi_sql('split', 'signal_type', 'p')} SELECT signal_type, {rnd('psi', 4)} AS psi, CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS drift, psi >= 0.25 AS retrain FROM p", "agg")
def drift_report(spark, d):
    return qu.drift_report(_agg(spark, d))


@query(f"WITH split AS (SELECT *, date >= DATE '2000-01-01' AS recent FROM agg), {psi_sql('split', 'district_id, signal_type', 'p')} SELECT district_id, signal_type, {rnd('psi', 4)} AS psi FROM p", "agg")
def psi(spark, d):
    split = _agg(spark, d).withColumn("recent", F.col("date") >= F.lit("2000-01-01").cast("date"))
    return st.psi(split, ["district_id", "signal_type"], "recent").withColumn("psi", sc.rounded("psi", 4))


# Knowledge, matching, explanations


@query("SELECT disease, ordinal, display_name, category, r0, incubation_days, infectious_days, ifr FROM disease WHERE category IN (SELECT category FROM assessed)", "know", "assessed")
def disease_dim(spark, d):
    seen = _assessed(spark, d).select("category").distinct()
    return kn.diseases(spark).join(seen, "category", "left_semi").select("disease", "ordinal", "display_name", "category", "r0", "incubation_days", "infectious_days", "ifr")


@query(f"SELECT signal_type, {rnd('idf', 6)} AS idf FROM idf WHERE signal_type IN (SELECT signal_type FROM drivers)", "idf", "drivers")
def signal_idf(spark, d):
    used = de.drivers(_agg(spark, d)).select("signal_type").distinct()
    return kn.signal_idf(kn.disease_signals(spark)).join(used, "signal_type", "left_semi").withColumn("idf", sc.rounded("idf", 6))


@query("SELECT district_id, date, disease, score, rank FROM matches", "matches")
def disease_match(spark, d):
    agg = _signals(spark, d)
    return kn.match_diseases(de.drivers(agg), kn.weather_state(agg))


@query("SELECT district_id, date, rank, label, value, detail FROM contributions", "contributions")
def contributions(spark, d):
    return ri.explanations(_signals(spark, d))


@query("SELECT district_id, date, risk_score, level FROM risk", "risk")
def risk_score(spark, d):
    return _risk(spark, d)


_RAW = ", ".join(x.replace("daily", "raw") for x in (_QUALITY, _MISSING, _OUTLIER))
_CONFIDENCE = f"{_RAW}, conf AS (SELECT district_id, date, {rnd('greatest(0.0, least(1.0, (SELECT avg(reliability) FROM reliability) * (1 - CAST(0.6 AS DOUBLE) * missing_ratio) * (1 - CAST(0.3 AS DOUBLE) * outlier_ratio)))', 4)} AS confidence FROM missing JOIN outliers USING (district_id, date))"
_TEMPERED = f"{_CONFIDENCE}, held AS (SELECT p.*, coalesce(confidence, 1.0) AS confidence FROM parts p LEFT JOIN conf USING (district_id, date)), tempered AS (SELECT *, {level('risk_score')} AS level FROM (SELECT district_id, date, confidence, {', '.join(de.DETECTORS)}, {tempered('confidence')} AS risk_score FROM held))"


def _signals_and_confidence(spark, d) -> tuple[DataFrame, DataFrame]:
    """The weekly signals, and the confidence of each of their days by source: order lines are read and joined once for both."""
    cells = written(ad.weekly_cells(spark, d, by_source=True))
    confidence = qu.daily_confidence(written(ad.signals_of(cells, by_source=True))).select("district_id", "date", "confidence")
    return written(ad.signals_of(cells).select("district_id", "date", "signal_type", "value")), written(confidence)


@query(f"WITH {_TEMPERED} SELECT district_id, date, confidence, risk_score, level FROM tempered", "risk", "raw")
def confident_risk(spark, d):
    agg, confidence = _signals_and_confidence(spark, d)
    return ri.assess_risk(agg, confidence).join(confidence, ["district_id", "date"], "left").select("district_id", "date", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "risk_score", "level")


_FULL = f"""{_TEMPERED}, why AS (SELECT district_id, date, string_agg(label || ' ' || detail, ' | ' ORDER BY rank) AS why FROM contributions GROUP BY district_id, date)
SELECT t.district_id, t.date, coalesce(p.name, t.district_id) AS district_name, risk_score, level, confidence, {', '.join(rnd(x, 4) + f' AS {x}' for x in de.DETECTORS)}, CASE WHEN level <> 'Normal' THEN coalesce(category, 'Unknown') ELSE 'Unknown' END AS category,
CASE WHEN level <> 'Normal' THEN coalesce(likely, '') ELSE '' END AS likely_diseases, CASE WHEN level <> 'Normal' THEN coalesce(best, 0.0) ELSE 0.0 END AS best_match, CASE WHEN level <> 'Normal' THEN coalesce(why, '') ELSE '' END AS contributions
FROM tempered t LEFT JOIN best b USING (district_id, date) LEFT JOIN why USING (district_id, date) LEFT JOIN districts p USING (district_id)"""


@query(f"WITH {_FULL}", "assessed", "contributions", "raw")
def risk_assessment(spark, d):
    agg, confidence = _signals_and_confidence(spark, d)
    full = ri.full_assessment(agg, ad.districts(spark, d), confidence)
    why = F.array_join(F.transform("contributions", lambda x: F.concat(x["label"], F.lit(" "), x["detail"])), " | ").alias("contributions")
    return full.select("district_id", "date", "district_name", "risk_score", "level", "confidence", *[sc.rounded(x, 4).alias(x) for x in de.DETECTORS], "category", "likely_diseases", "best_match", why)


_NOVEL = "risk_score >= 55 AND novelty >= 0.6 AND best_match < 0.85"


@query(f"WITH n AS (SELECT a.*, least(1.0, coalesce(x, 0.0)) AS novelty FROM assessed a LEFT JOIN (SELECT district_id, date, max(anomaly) AS x FROM drivers GROUP BY district_id, date) USING (district_id, date)) SELECT district_id, date, {_NOVEL} AS novel, CASE WHEN {_NOVEL} THEN 'Unknown' ELSE category END AS category, CASE WHEN {_NOVEL} THEN '' ELSE likely_diseases END AS likely_diseases FROM n", "assessed", "drivers")
def novelty_gate(spark, d):
    agg = _signals(spark, d)
    strongest = de.drivers(agg).groupBy("district_id", "date").agg(F.max("anomaly").alias("x"))
    scored = ri.risk_assessment(agg, ad.districts(spark, d)).join(strongest, ["district_id", "date"], "left").withColumn("novelty", F.least(F.lit(1.0), F.coalesce("x", F.lit(0.0))))
    return ri.novelty_gate(scored).select("district_id", "date", "novel", "category", "likely_diseases")


# Roll-ups and reads


@query("SELECT district_id, district_name, date, risk_score, level FROM named", "named")
def risk_named(spark, d):
    return _latest(spark, d).select("district_id", "district_name", "date", "risk_score", "level")


@query(f"SELECT date, {rnd('sum(CAST(floor(risk_score * 100 + 0.5) AS BIGINT)) / count(risk_score) / 100', 2)} AS mean_risk, {rnd('max(risk_score)', 2)} AS max_risk FROM risk GROUP BY date", "risk")
def risk_timeline(spark, d):
    return ro.risk_timeline(_risk(spark, d))


@query(f"SELECT signal_type, date, {rnd('avg(value)', 3)} AS value FROM agg WHERE district_id = 'NATION_3' GROUP BY signal_type, date", "agg")
def signal_daily_mean(spark, d):
    return ro.signal_daily_mean(_agg(spark, d), "NATION_3")


@query(f"SELECT region, count(*) AS n_districts, count(*) FILTER (WHERE {LEVEL_ORDER} >= 1) AS n_elevated, count(*) FILTER (WHERE {LEVEL_ORDER} >= 3) AS n_alerts, max(row(risk_score, district_id))[2] AS top_district, max(risk_score) AS top_risk FROM named GROUP BY ROLLUP (region)", "named")
def national_rollup(spark, d):
    return ro.national_rollup(_latest(spark, d))


@query("SELECT region, district_id, risk_score, level FROM named ORDER BY risk_score DESC, district_id LIMIT 10", "named")
def national_hotspots(spark, d):
    return ro.top_risk(_latest(spark, d)).select("region", "district_id", "risk_score", "level")


@query(f"SELECT d.region, count(*) AS n_districts, sum(population)::BIGINT AS population, (SELECT count(*) FROM named n WHERE n.region = d.region AND {LEVEL_ORDER} >= 1) AS n_active FROM districts d GROUP BY d.region", "named")
def region_meta(spark, d):
    return ro.region_meta(_latest(spark, d), ad.districts(spark, d))


@query("SELECT category, count(*) AS n FROM assessed WHERE level <> 'Normal' GROUP BY category", "assessed")
def category_distribution(spark, d):
    return ro.category_distribution(_assessed(spark, d))


@query("SELECT count(*) AS districts, " + ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS {x.lower()}" for x in sc.LEVELS[1:]) + f", {rnd('max(risk_score)', 2)} AS max_risk FROM latest", "latest")
def level_kpis(spark, d):
    return ro.level_kpis(ri.latest_by_district(_risk(spark, d)))


@query("SELECT district_id, risk_score, level FROM latest ORDER BY risk_score DESC, district_id LIMIT 10", "latest")
def top_risk(spark, d):
    return ro.top_risk(ri.latest_by_district(_risk(spark, d))).select("district_id", "risk_score", "level")


@query("SELECT district_id, risk_score, level FROM latest ORDER BY risk_score DESC, district_id LIMIT 7 OFFSET 5", "latest")
def paged_risk(spark, d):
    return ro.paged(ri.latest_by_district(_risk(spark, d)), 7, 5).select("district_id", "risk_score", "level")


@query("SELECT district_id, risk_score, level FROM risk WHERE date = DATE '2001-09-10'", "risk")
def risk_snapshot(spark, d):
    return ro.snapshot(_risk(spark, d), F.lit("2001-09-10").cast("date")).select("district_id", "risk_score", "level")


@query("SELECT district_id, date, risk_score, level FROM risk", "risk")
def risk_timeseries(spark, d):
    return _risk(spark, d).select("district_id", "date", "risk_score", "level")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_events(spark, d):
    return ro.recent(ad.read(spark, d, "events", "event_id", "ts", "user_id", "event_type")).select("event_id", "user_id", "event_type")


@query("""WITH log AS (SELECT region, signal_type AS artifact, date AS updated_at, count(*) AS rows FROM daily GROUP BY ALL)
SELECT region, artifact, arg_max(rows, updated_at) AS rows, max(updated_at) AS updated_at FROM log GROUP BY region, artifact""".replace("GROUP BY ALL", "GROUP BY region, signal_type, date"), "daily")
def artifact_catalog(spark, d):
    log = ad.daily_signals(spark, d).groupBy("region", F.col("signal_type").alias("artifact"), F.col("date").alias("updated_at")).agg(F.count("*").alias("rows"))
    return ro.catalog(log)


@query("""SELECT c_mktsegment AS name, 'v' || count(*) AS version, count(*) AS n_versions, max(o_orderdate)::DATE AS created_at FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def registry_latest(spark, d):
    runs = ad.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(ad.read(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return ro.registry_latest(runs.select(F.col("c_mktsegment").alias("name"), F.to_date("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run")))


_ALERTS = f"al AS (SELECT a.*, {LEVEL_ORDER} AS o FROM assessed a WHERE {LEVEL_ORDER} >= 1)"


@query(f"WITH {_ALERTS} SELECT district_id, date, risk_score, level, category, row_number() OVER (PARTITION BY date ORDER BY o DESC, risk_score DESC, district_id) AS rank FROM al WHERE o >= 2", "assessed")
def alerts(spark, d):
    return al.ranked(al.alert_filter(_assessed(spark, d), "Warning")).select("district_id", "date", "risk_score", "level", "category", "rank")


@query(f"WITH {_ALERTS} SELECT district_id, date, substr(sha1(district_id || ':' || strftime(date, '%Y-%m-%d') || ':' || level), 1, 12) AS alert_id FROM al", "assessed")
def alert_id(spark, d):
    return al.alert_id(al.alert_filter(_assessed(spark, d))).select("district_id", "date", "alert_id")


@query(f"WITH {_ALERTS} SELECT district_id, date, level || ': possible ' || lower(category) || ' outbreak in ' || district_name || ' (risk ' || printf('%.0f', risk_score) || '/100)' AS headline FROM al", "assessed")
def alert_headline(spark, d):
    return al.headline(al.alert_filter(_assessed(spark, d))).select("district_id", "date", "headline")


@query(f"""WITH {_ALERTS}, acts AS (SELECT category, string_agg(action, ' | ' ORDER BY ord) AS acts FROM category_actions GROUP BY category),
why AS (SELECT district_id, date, string_agg(label || ' ' || detail, ' | ' ORDER BY rank) AS why FROM (SELECT *, row_number() OVER (PARTITION BY district_id, date ORDER BY rank) AS k FROM contributions) WHERE k <= 5 GROUP BY district_id, date)
SELECT district_id, date, concat_ws(' | ', why, CASE WHEN likely_diseases <> '' THEN 'Most likely: ' || likely_diseases END) AS reasons, concat_ws(' | ', la.action, acts) AS actions, array_to_string(['dashboard', 'email', 'sms', 'whatsapp'][1:o], ',') AS channels
FROM al JOIN level_actions la USING (level) LEFT JOIN acts USING (category) LEFT JOIN why USING (district_id, date)""", "assessed", "contributions", "actions")
def alert_payload(spark, d):
    agg = _signals(spark, d)
    rows = al.channels(al.actions(al.reasons(al.alert_filter(ri.risk_assessment(agg, ad.districts(spark, d))), ri.explanations(agg))))
    return rows.select("district_id", "date", F.array_join("reasons", " | ").alias("reasons"), F.array_join("actions", " | ").alias("actions"), F.array_join("channels", ",").alias("channels"))


# Graph

_EDGES = """adj AS (SELECT DISTINCT least(district_id, x) AS u, greatest(district_id, x) AS v FROM (SELECT district_id, unnest(neighbors) AS x FROM districts) WHERE x IN (SELECT district_id FROM districts) AND x <> district_id),
pulled AS (SELECT a.region, u, v, CAST(a.population AS DOUBLE) * b.population / (km * km) AS g FROM (SELECT u, v, greatest(1.0, 2 * CAST(6371.0 AS DOUBLE) * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))) AS km FROM adj JOIN districts a ON u = a.district_id JOIN districts b ON v = b.district_id) JOIN districts a ON u = a.district_id JOIN districts b ON v = b.district_id),
gravity AS (SELECT region, u, v, g / max(g) OVER (PARTITION BY region) AS weight FROM pulled),
mirror AS (SELECT region, u, v, weight FROM gravity UNION ALL SELECT region, v, u, weight FROM gravity)"""
_NORMAL = "whole AS (SELECT u, v, weight FROM mirror UNION ALL SELECT district_id, district_id, 1.0 FROM districts), degree AS (SELECT u, sum(weight) AS d FROM whole GROUP BY u), normal AS (SELECT w.u, w.v, weight / sqrt(a.d) / sqrt(b.d) AS a FROM whole w JOIN degree a ON w.u = a.u JOIN degree b ON w.v = b.u)"


@query(f"WITH {_EDGES} SELECT region, u, v, {rnd('weight', 6)} AS weight FROM gravity", "districts")
def gravity_edges(spark, d):
    return gr.gravity_edges(ad.districts(spark, d)).withColumn("weight", sc.rounded("weight", 6))


@query(f"WITH {_EDGES}, {_NORMAL} SELECT u, v, {rnd('a', 6)} AS a FROM normal", "districts")
def normalized_adjacency(spark, d):
    places = ad.districts(spark, d)
    return gr.normalized_adjacency(places, gr.gravity_edges(places)).withColumn("a", sc.rounded("a", 6))


@query(f"WITH {_EDGES}, {_NORMAL}, feats AS (SELECT district_id, coalesce(risk_score, 0.0) / 100 AS risk, ln(population) / max(ln(population)) OVER () AS pop FROM districts LEFT JOIN latest USING (district_id)) SELECT u AS district_id, {rnd('sum(a * risk)', 6)} AS risk, {rnd('sum(a * pop)', 6)} AS pop FROM normal JOIN feats ON v = district_id GROUP BY u", "latest", "districts")
def neighbor_features(spark, d):
    places = ad.districts(spark, d)
    largest = places.agg(F.max(F.log("population")).alias("top"))
    feats = places.join(ri.latest_by_district(_risk(spark, d)), "district_id", "left").crossJoin(F.broadcast(largest)).select("district_id", (F.coalesce("risk_score", F.lit(0.0)) / 100).alias("risk"), (F.log("population") / F.col("top")).alias("pop"))
    return gr.neighbor_features(gr.normalized_adjacency(places, gr.gravity_edges(places)), feats)


_days = ["p0 AS (SELECT region, district_id, coalesce(risk_score, 0.0) / 100 AS p FROM districts LEFT JOIN latest USING (district_id))"] + [f"p{i} AS MATERIALIZED (SELECT a.region, a.district_id, least(1.0, any_value(a.p) + (1 - any_value(a.p)) * (CAST(0.04 AS DOUBLE) * any_value(a.p) + CAST(0.085 AS DOUBLE) * coalesce(sum(weight * b.p), 0.0))) AS p FROM p{i - 1} a LEFT JOIN mirror m ON m.u = a.district_id LEFT JOIN p{i - 1} b ON b.district_id = m.v GROUP BY a.region, a.district_id)" for i in range(1, 31)]
_SPREAD = f"{_EDGES}, {', '.join(_days)}, spread AS (" + " UNION ALL ".join(f"SELECT region, district_id, {h} AS horizon_days, {rnd('p', 4)} AS risk_probability FROM p{h}" for h in gr.HORIZONS) + ")"


def _spread(spark, d) -> DataFrame:
    places = ad.districts(spark, d)
    return gr.spread_forecast(written(ri.latest_by_district(_risk(spark, d))), places, gr.gravity_edges(places))


@query(f"WITH {_SPREAD} SELECT * FROM spread", "latest", "districts")
def spread_forecast(spark, d):
    return _spread(spark, d)


@query(f"WITH {_SPREAD} SELECT region, district_id, risk_probability AS prob, row_number() OVER (PARTITION BY region ORDER BY risk_probability DESC, district_id) AS rank FROM spread WHERE horizon_days = 30", "latest", "districts")
def forecast_rank(spark, d):
    return gr.forecast_rank(_spread(spark, d))


@query(f"WITH {_SPREAD} SELECT * FROM (SELECT region, district_id, risk_probability AS prob, row_number() OVER (PARTITION BY region ORDER BY risk_probability DESC, district_id) AS rank FROM spread WHERE horizon_days = 30 AND district_id NOT IN (SELECT district_id FROM latest WHERE level <> 'Normal')) WHERE rank <= 4", "latest", "districts")
def spread_outlook(spark, d):
    places, latest = ad.districts(spark, d), written(ri.latest_by_district(_risk(spark, d)))
    return ro.spread_outlook(gr.spread_forecast(latest, places, gr.gravity_edges(places)), latest)


__all__ = ["QUERIES", "SQL", "listed"]
