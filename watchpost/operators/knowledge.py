"""Disease knowledge as small tables, and matching of evidence against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import rounded

# The diseases, in order, with category, vectors, symptoms, signals, weather drivers and epidemic parameters.
DISEASES = [
    ("dengue", "Dengue", "Vector", ["Aedes mosquito"], ["fever", "rash", "body_pain", "headache", "vomiting"], ["search_fever", "search_rash", "search_vomiting", "hospital_admissions", "icu_occupancy", "lab_pcr_requests", "social_mentions", "wastewater_viral_load"], {"rainfall": "positive", "humidity": "positive", "temp": "positive"}, (2.4, 5.0, 6.0, 0.001)),
    ("chikungunya", "Chikungunya", "Vector", ["Aedes mosquito"], ["fever", "rash", "body_pain", "headache"], ["search_fever", "search_rash", "hospital_admissions", "social_mentions"], {"rainfall": "positive", "humidity": "positive", "temp": "positive"}, (2.0, 4.0, 5.0, 0.0005)),
    ("influenza_like", "Influenza-like illness", "Respiratory", [], ["fever", "cough", "body_pain", "headache"], ["search_fever", "search_cough", "hospital_admissions", "icu_occupancy", "ventilator_usage", "lab_pcr_requests", "social_mentions", "wastewater_viral_load"], {"temp": "negative", "humidity": "neutral", "rainfall": "neutral"}, (1.5, 2.0, 4.0, 0.001)),
    ("covid_like", "COVID-like respiratory syndrome", "Respiratory", [], ["fever", "cough", "loss_of_smell", "body_pain"], ["search_fever", "search_cough", "hospital_admissions", "icu_occupancy", "ventilator_usage", "mortality", "lab_pcr_requests", "wastewater_viral_load"], {"temp": "negative", "humidity": "neutral", "rainfall": "neutral"}, (3.0, 5.0, 7.0, 0.005)),
    ("cholera", "Cholera / acute diarrheal disease", "Waterborne", ["contaminated water"], ["diarrhea", "vomiting", "dehydration"], ["search_diarrhea", "search_vomiting", "hospital_admissions", "lab_pcr_requests", "social_mentions", "wastewater_viral_load"], {"rainfall": "positive", "temp": "positive", "humidity": "neutral"}, (1.8, 2.0, 5.0, 0.01)),
    ("leptospirosis", "Leptospirosis", "Waterborne", ["contaminated water", "rodents"], ["fever", "body_pain", "headache", "jaundice"], ["search_fever", "hospital_admissions", "icu_occupancy", "mortality", "lab_pcr_requests"], {"rainfall": "positive", "humidity": "positive", "temp": "neutral"}, (1.3, 10.0, 7.0, 0.05)),
    ("food_poisoning", "Foodborne illness", "Foodborne", ["contaminated food"], ["vomiting", "diarrhea", "nausea"], ["search_vomiting", "search_diarrhea", "hospital_admissions", "social_mentions"], {"temp": "positive", "humidity": "positive", "rainfall": "neutral"}, (1.2, 1.0, 3.0, 0.002)),
]
WEATHER_BONUS = {("positive", "high"): 0.04, ("negative", "low"): 0.03}


def diseases(spark: SparkSession) -> DataFrame:
    """(disease, ordinal, display_name, category, r0, incubation_days, infectious_days, ifr)."""
    rows = [(key, i, name, category, *epi) for i, (key, name, category, _, _, _, _, epi) in enumerate(DISEASES)]
    return spark.createDataFrame(rows, "disease string, ordinal int, display_name string, category string, r0 double, incubation_days double, infectious_days double, ifr double")


def disease_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d[0], s) for d in DISEASES for s in d[5]], "disease string, signal_type string")


def disease_weather(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d[0], driver, effect) for d in DISEASES for driver, effect in d[6].items()], "disease string, driver string, effect string")


def kg_edges(spark: SparkSession) -> DataFrame:
    """(src, relation, dst): symptoms, vectors, signals and favourable weather of each disease."""
    rows = [(d[0], "presents", f"symptom:{x}") for d in DISEASES for x in d[4]] + [(d[0], "transmitted_by", f"vector:{x}") for d in DISEASES for x in d[3]]
    rows += [(d[0], "observed_via", f"signal:{x}") for d in DISEASES for x in d[5]] + [(d[0], "driven_by", f"weather:{x}") for d in DISEASES for x, effect in d[6].items() if effect == "positive"]
    return spark.createDataFrame(rows, "src string, relation string, dst string")


def kg_neighbors(edges: DataFrame, node: str) -> DataFrame:
    there = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbor"))
    return there.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("neighbor"))).distinct()


def signal_idf(profile: DataFrame) -> DataFrame:
    """(signal_type, idf): ln((1 + n) / (1 + df)) + 1 over diseases."""
    n = profile.agg(F.countDistinct("disease").alias("_n"))
    df = profile.groupBy("signal_type").agg(F.countDistinct("disease").alias("_df"))
    return df.crossJoin(F.broadcast(n)).select("signal_type", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))


def weather_state(agg: DataFrame) -> DataFrame:
    """(district_id, date, driver, state): high from the series' 0.7 quantile, low up to its 0.3 quantile."""
    weather = agg.where(F.col("signal_type").startswith("weather_"))
    q = F.percentile("value", F.array(F.lit(0.3), F.lit(0.7))).over(Window.partitionBy("district_id", "signal_type"))
    state = F.when(F.col("value") >= F.col("_q")[1], "high").when(F.col("value") <= F.col("_q")[0], "low").otherwise("normal")
    return weather.withColumn("_q", q).select("district_id", "date", F.regexp_replace("signal_type", "^weather_", "").alias("driver"), state.alias("state"))


def match_diseases(drivers: DataFrame, weather: DataFrame, top: int = 3, least: float = 0.05) -> DataFrame:
    """(district_id, date, disease, score, rank): IDF-weighted overlap of elevated signals with each profile, and a small
    bonus for favourable weather; diseases without a match go; equal scores keep the diseases' order."""
    spark = drivers.sparkSession
    cell = ["district_id", "date"]
    weighted = disease_signals(spark).join(signal_idf(disease_signals(spark)), "signal_type")
    total = weighted.groupBy("disease").agg(F.sum("idf").alias("_total"))
    elevated = drivers.where((F.col("anomaly") > least) & (F.col("signal_type") != "multivariate_context"))
    matched = elevated.join(F.broadcast(weighted), "signal_type").groupBy(*cell, "disease").agg(F.sum(F.col("anomaly") * F.col("idf")).alias("_match"))
    bonus = F.lit(0.0)
    for (effect, state), more in WEATHER_BONUS.items():
        bonus = bonus + F.when((F.col("effect") == effect) & (F.col("state") == state), more).otherwise(0.0)
    favoured = weather.join(F.broadcast(disease_weather(spark)), "driver").groupBy(*cell, "disease").agg(F.sum(bonus).alias("_bonus"))
    scored = matched.join(F.broadcast(total), "disease").join(favoured, [*cell, "disease"], "left").join(F.broadcast(diseases(spark).select("disease", "ordinal")), "disease")
    score = rounded(F.least(F.lit(1.0), F.col("_match") / F.col("_total") + F.coalesce("_bonus", F.lit(0.0))), 4)
    ranked = scored.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("score"), "ordinal")))
    return ranked.where(F.col("rank") <= top).select(*cell, "disease", "score", "rank")
