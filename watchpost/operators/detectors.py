"""Anomaly detectors: each takes aggregated signals and returns (district_id, date, detector, score); drivers are long rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.kernels import trailing
from watchpost.functions.scoring import anomaly_from_z, rounded
from watchpost.functions.stats import deseasonal_z, rolling_robust_z

# The signals of each detector.
SEARCH = ("search_fever", "search_cough", "search_rash", "search_vomiting", "search_diarrhea")
HOSPITAL = ("hospital_admissions", "icu_occupancy", "ventilator_usage", "mortality", "lab_pcr_requests")
SOCIAL = ("social_mentions",)
WASTEWATER = ("wastewater_viral_load",)
DETECTORS = ("search", "hospital", "social", "wastewater")
CELL = ["district_id", "date"]


def search_anomalies(agg: DataFrame, deseasonalised: Callable[[DataFrame], DataFrame] = deseasonal_z) -> DataFrame:
    """`deseasonalised` adds z: by the median cycle, or kernels.stl_residual_z for a cycle that changes and is robust against outbreaks."""
    z = deseasonalised(agg.where(F.col("signal_type").isin(*SEARCH)))
    return z.select(*CELL, "signal_type", "z", anomaly_from_z("z").alias("anomaly"))


def trailing_anomalies(agg: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    z = rolling_robust_z(agg.where(F.col("signal_type").isin(*signals)))
    return z.select(*CELL, "signal_type", "z", anomaly_from_z("z").alias("anomaly"))


def corroborated_top2(anomalies: DataFrame) -> DataFrame:
    """(district_id, date, score): 0.6 of the largest anomaly of the cell and 0.4 of the second."""
    w = Window.partitionBy(*CELL).orderBy(F.desc("anomaly"), "signal_type")
    ranked = anomalies.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    return ranked.groupBy(*CELL).agg(F.sum(F.when(F.col("_k") == 1, 0.6 * F.col("anomaly")).otherwise(0.4 * F.col("anomaly"))).alias("score"))


def detect_search(agg: DataFrame, deseasonalised: Callable[[DataFrame], DataFrame] = deseasonal_z) -> DataFrame:
    return corroborated_top2(search_anomalies(agg, deseasonalised)).select(*CELL, F.lit("search").alias("detector"), "score")


def joint_context(anomalies: DataFrame) -> DataFrame:
    """(district_id, date, context): length of the z-vector, scaled between its median and 99th percentile in the district;
    districts of under 20 days have none."""
    return _scaled(anomalies.groupBy(*CELL).agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("_r")))


def _scaled(cells: DataFrame) -> DataFrame:
    """`_r` of each cell as `context`, between its median and 99th percentile over the district's days; null where there is none."""
    days = Window.partitionBy("district_id")
    placed = cells.withColumns({"_q": F.percentile("_r", F.array(F.lit(0.5), F.lit(0.99))).over(days), "_n": F.count("_r").over(days)})
    low, high = F.col("_q")[0], F.col("_q")[1]
    context = F.when((F.col("_n") >= 20) & (high > low), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_r") - low) / (high - low)))).otherwise(0.0)
    return placed.withColumn("context", F.when(F.col("_r").isNotNull(), context)).drop("_r", "_q", "_n")


def detect_hospital(agg: DataFrame) -> DataFrame:
    anomalies = trailing_anomalies(agg, HOSPITAL)
    base = anomalies.groupBy(*CELL).agg(F.avg("anomaly").alias("_base"))
    score = F.least(F.lit(1.0), F.col("_base") * (1 + 0.4 * F.col("context")))
    return base.join(joint_context(anomalies), CELL).select(*CELL, F.lit("hospital").alias("detector"), score.alias("score"))


def detect_single(agg: DataFrame, signals: tuple[str, ...], detector: str) -> DataFrame:
    return trailing_anomalies(agg, signals).select(*CELL, F.lit(detector).alias("detector"), F.col("anomaly").alias("score"))


def detect_social(agg: DataFrame) -> DataFrame:
    return detect_single(agg, SOCIAL, "social")


def detect_wastewater(agg: DataFrame) -> DataFrame:
    return detect_single(agg, WASTEWATER, "wastewater")


def run_detectors(agg: DataFrame, detectors=(detect_search, detect_hospital, detect_social, detect_wastewater)) -> DataFrame:
    return reduce(DataFrame.unionByName, [d(agg) for d in detectors])


def scores_to_frame(scores: DataFrame) -> DataFrame:
    """A column for each detector; an absent one is null."""
    return scores.groupBy(*CELL).pivot("detector", list(DETECTORS)).agg(F.max("score"))


def all_anomalies(agg: DataFrame) -> DataFrame:
    """(district_id, date, signal_type, z, anomaly) of every signal that a detector reads, each series gone through once."""
    return search_anomalies(agg).unionByName(trailing_anomalies(agg, HOSPITAL + SOCIAL + WASTEWATER))


def described(agg: DataFrame) -> DataFrame:
    """agg with the trailing z and the baseline of every series, from one pass."""
    return trailing(agg, ["district_id", "signal_type"], z="z", baseline="baseline")


def anomalies_of(series: DataFrame) -> DataFrame:
    """all_anomalies from `described` series, which should be written: only searches, without their season, are gone through once more."""
    rest = series.where(F.col("signal_type").isin(*HOSPITAL, *SOCIAL, *WASTEWATER)).select(*CELL, "signal_type", "z", anomaly_from_z("z").alias("anomaly"))
    return search_anomalies(series.select(*CELL, "signal_type", "value")).unionByName(rest)


def scores_wide(anomalies: DataFrame) -> DataFrame:
    """The frame of all detectors' scores from all_anomalies, in one aggregation by cell."""
    of = lambda signals, x: F.when(F.col("signal_type").isin(*signals), x)
    worst = F.sort_array(F.collect_list(of(SEARCH, F.struct((-F.col("anomaly")).alias("low"), "signal_type"))))
    cells = anomalies.groupBy(*CELL).agg(
        worst.alias("_worst"),
        F.avg(of(HOSPITAL, F.col("anomaly"))).alias("_base"),
        F.sqrt(F.sum(of(HOSPITAL, F.col("z") * F.col("z")))).alias("_r"),
        F.max(of(SOCIAL, F.col("anomaly"))).alias("social"),
        F.max(of(WASTEWATER, F.col("anomaly"))).alias("wastewater"),
    )
    first, second = (-F.get("_worst", F.lit(i))["low"] for i in (0, 1))
    search = F.when(F.size("_worst") > 0, 0.6 * first + F.coalesce(0.4 * second, F.lit(0.0)))
    hospital = F.when(F.col("_base").isNotNull(), F.least(F.lit(1.0), F.col("_base") * (1 + 0.4 * F.col("context"))))
    return _scaled(cells).select(*CELL, search.alias("search"), hospital.alias("hospital"), "social", "wastewater")


def drivers(agg: DataFrame) -> DataFrame:
    return drivers_of(all_anomalies(agg))


def drivers_of(anomalies: DataFrame) -> DataFrame:
    """(district_id, date, signal_type, anomaly): the largest anomaly of each signal over 0.01, with three decimals, and the
    hospital context as a driver of its own."""
    context = joint_context(anomalies.where(F.col("signal_type").isin(*HOSPITAL))).select(*CELL, F.lit("multivariate_context").alias("signal_type"), F.col("context").alias("anomaly"))
    every = anomalies.drop("z").unionByName(context)
    return every.where("anomaly > 0.01").groupBy(*CELL, "signal_type").agg(F.max(rounded("anomaly", 3)).alias("anomaly"))
