"""Fused risk for each district and day, its level, likely diseases and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import clamp, level_for, level_order, rounded, signed_percent
from watchpost.functions.stats import against_baseline, pct_vs_baseline
from watchpost.operators.detectors import DETECTORS, all_anomalies, anomalies_of, described, drivers_of, scores_wide
from watchpost.operators.knowledge import diseases, match_diseases, weather_state
from watchpost.sources.shared import written

CELL = ["district_id", "date"]
# Detector weights and the labels of signals and weather drivers.
WEIGHTS = {"hospital": 0.35, "search": 0.30, "wastewater": 0.20, "social": 0.15}
LABELS = {"hospital_admissions": "Hospital admissions", "icu_occupancy": "ICU occupancy", "ventilator_usage": "Ventilator usage", "mortality": "Mortality", "lab_pcr_requests": "PCR test requests", "search_fever": "Fever searches", "search_cough": "Cough searches", "search_rash": "Rash searches", "search_vomiting": "Vomiting searches", "search_diarrhea": "Diarrhea searches", "social_mentions": "Social media mentions", "wastewater_viral_load": "Wastewater viral load", "multivariate_context": "Unusual joint hospital pattern"}
#: The detail of a driver without a baseline, and label and detail of favourable weather.
ANOMALOUS, FAVOURABLE, ELEVATED = "anomalous pattern", " (favourable conditions)", "elevated — supports environmental transmission"
WEATHER_LABELS = {"rainfall": "Rainfall", "humidity": "Humidity", "temp": "Temperature"}
UNKNOWN = "Unknown"


def risk_score(wide: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """(district_id, date, risk_score): weighted mean of the detectors that are there, by 0.7 + 0.3 confidence (held to 0..1, 1 where
    unknown), in 0..100 with two decimals."""
    held = wide if confidence is None else wide.join(confidence.select(*CELL, "confidence"), CELL, "left")
    trust = F.lit(1.0) if confidence is None else F.coalesce(clamp("confidence"), F.lit(1.0))
    up = sum((w * F.coalesce(clamp(F.col(d)), F.lit(0.0)) for d, w in WEIGHTS.items()), F.lit(0.0))
    down = sum((F.when(F.col(d).isNotNull(), w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    fused = F.when(down > 0, up / down).otherwise(0.0)
    return held.select(*CELL, rounded(fused * (0.7 + 0.3 * trust) * 100, 2).alias("risk_score"))


def assess_risk(agg: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """(district_id, date, risk_score, level) of every district and day."""
    return risk_score(scores_wide(all_anomalies(agg)), confidence).withColumn("level", level_for("risk_score"))


def latest_by_district(risk: DataFrame) -> DataFrame:
    w = Window.partitionBy("district_id").orderBy(F.desc("date"), F.desc("risk_score"))
    return risk.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def named(risk: DataFrame, districts: DataFrame) -> DataFrame:
    """With district_name, the id where the district is unknown."""
    names = districts.select("district_id", F.col("name").alias("_name"))
    return risk.join(names, "district_id", "left").withColumn("district_name", F.coalesce("_name", "district_id")).drop("_name")


def contributions(driver_rows: DataFrame, pct: DataFrame, weather: DataFrame, top: int = 6) -> DataFrame:
    """(district_id, date, rank, label, value, detail): the strongest drivers, then high weather drivers by name."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    w = Window.partitionBy(*CELL).orderBy(F.desc("anomaly"), "signal_type")
    ranked = driver_rows.where("anomaly > 0.01").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    joined = ranked.join(pct.select(*CELL, "signal_type", "pct"), [*CELL, "signal_type"], "left")
    known = F.col("pct").isNotNull() & (F.col("signal_type") != "multivariate_context")
    value = F.when(known, rounded("pct", 1)).otherwise(rounded(F.col("anomaly") * 100, 1))
    signals = joined.select(*CELL, "rank", label[F.col("signal_type")].alias("label"), value.alias("value"), F.when(known, signed_percent(value)).otherwise(ANOMALOUS).alias("detail"))
    weather_label = F.create_map(*[F.lit(x) for pair in WEATHER_LABELS.items() for x in pair])
    order = F.row_number().over(Window.partitionBy(*CELL).orderBy("driver")) + top
    high = weather.where("state = 'high'").select(*CELL, order.alias("rank"), F.concat(weather_label[F.col("driver")], F.lit(FAVOURABLE)).alias("label"), F.lit(0.0).alias("value"), F.lit(ELEVATED).alias("detail"))
    return signals.unionByName(high)


def novelty_gate(assessed: DataFrame) -> DataFrame:
    """Unknown category and no diseases where risk is high, the pattern is new and nothing matches well."""
    new = (F.col("risk_score") >= 55) & (F.col("novelty") >= 0.6) & (F.coalesce("best_match", F.lit(0.0)) < 0.85)
    return assessed.withColumns({"novel": new, "category": F.when(new, UNKNOWN).otherwise(F.col("category")), "likely_diseases": F.when(new, "").otherwise(F.col("likely_diseases"))})


def risk_assessment(agg: DataFrame, districts: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """(district_id, date, district_name, risk_score, level, category, likely_diseases, best_match, and the score of each detector): one plan
    for all cells, over anomalies that are written once. Diseases are matched from Watch upwards; the best match gives the category."""
    return _matched(written(all_anomalies(agg)), weather_state(agg), districts, confidence)


def _matched(anomalies: DataFrame, weather: DataFrame, districts: DataFrame, confidence: DataFrame | None) -> DataFrame:
    wide = scores_wide(anomalies)
    risk = risk_score(wide, confidence).withColumn("level", level_for("risk_score"))
    matches = match_diseases(drivers_of(anomalies), weather).join(F.broadcast(diseases(anomalies.sparkSession).select("disease", "display_name", "category")), "disease")
    per_cell = matches.groupBy(*CELL).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "display_name"))), lambda x: x["display_name"]), ", ").alias("_likely"),
        F.max(F.when(F.col("rank") == 1, F.col("category"))).alias("_category"),
        F.max("score").alias("_best"),
    )
    watched = level_order("level") >= 1
    joined = named(risk, districts).join(per_cell, CELL, "left").join(wide, CELL)
    return joined.select(*CELL, "district_name", "risk_score", "level", F.when(watched, F.coalesce("_category", F.lit(UNKNOWN))).otherwise(UNKNOWN).alias("category"), F.when(watched, F.coalesce("_likely", F.lit(""))).otherwise("").alias("likely_diseases"), F.when(watched, F.coalesce("_best", F.lit(0.0))).otherwise(0.0).alias("best_match"), *DETECTORS)


def full_assessment(agg: DataFrame, districts: DataFrame, confidence: DataFrame, novelty: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """risk_assessment tempered by the days' confidence, with confidence (1 where unknown), contributions (array of label, value and
    detail, from Watch upwards) and, where `novelty` is given (from elevated drivers to district_id, date, novelty), novelty_score, 0 below Watch,
    and novel: such a pattern's category is unknown and it has no likely diseases."""
    series, weather = written(described(agg)), weather_state(agg)
    anomalies = written(anomalies_of(series))
    drivers = written(drivers_of(anomalies))
    core = _matched(anomalies, weather, districts, confidence)
    watched = level_order("level") >= 1
    rows = core.where(watched).select(*CELL)
    known = [x.join(rows, CELL, "left_semi") for x in (drivers, against_baseline(series), weather)]
    why = contributions(*known).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("rank", "label", "value", "detail"))).alias("_why"))
    none = F.array().cast("array<struct<rank:int,label:string,value:double,detail:string>>")
    out = core.join(confidence.select(*CELL, "confidence"), CELL, "left").join(why, CELL, "left").withColumns({"confidence": F.coalesce(clamp("confidence"), F.lit(1.0)), "contributions": F.coalesce("_why", none)}).drop("_why")
    if novelty is None:
        return out
    elevated = drivers.where((F.col("anomaly") > 0.05) & (F.col("signal_type") != "multivariate_context"))
    scored = out.join(novelty(elevated).select(*CELL, F.col("novelty").alias("_novelty")), CELL, "left")
    gated = novelty_gate(scored.withColumn("novelty", F.when(watched, F.coalesce("_novelty", F.lit(0.0))).otherwise(0.0)).drop("_novelty"))
    return gated.withColumnRenamed("novelty", "novelty_score")


def explanations(agg: DataFrame) -> DataFrame:
    return contributions(drivers_of(all_anomalies(agg)), pct_vs_baseline(agg), weather_state(agg))
