"""Source reliability, data-quality confidence and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import clamp, drift_band, integrity_failed, rounded
from watchpost.functions.stats import group_robust_z, psi

SERIES = ["source_id", "district_id", "signal_type"]


def completeness(signals: DataFrame) -> DataFrame:
    """(series, completeness): rows with a value over the days in the whole input, at most 1."""
    days = signals.agg(F.countDistinct("date").alias("_days"))
    return signals.groupBy(*SERIES).agg(F.count("value").alias("_n")).crossJoin(F.broadcast(days)).select(*SERIES, F.least(F.lit(1.0), F.col("_n") / F.col("_days")).alias("completeness"))


def series_stability(signals: DataFrame) -> DataFrame:
    """(series, stability): 1 / (1 + cv) of the distance from a centred median over 7 rows; 1 for under 8 values."""
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(-3, 3)
    off = signals.where("value is not null").withColumn("_off", F.col("value") - F.percentile("value", F.lit(0.5)).over(w))
    cv = F.stddev_pop("_off") / F.greatest(F.abs(F.avg("value")), F.lit(1e-6))
    return off.groupBy(*SERIES).agg(F.when(F.count("*") < 8, 1.0).otherwise(1 / (1 + cv)).alias("stability"))


def series_integrity(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*SERIES).agg(F.avg(F.when(integrity_failed("value", "signal_type"), 0.0).otherwise(1.0)).alias("integrity"))


def source_reliability(signals: DataFrame) -> DataFrame:
    """(source_id, reliability, completeness, integrity, stability, notes): means over the source's series."""
    series = completeness(signals).join(series_integrity(signals), SERIES).join(series_stability(signals), SERIES, "left")
    means = series.groupBy("source_id").agg(F.avg("completeness").alias("c"), F.avg("integrity").alias("i"), F.avg(F.coalesce("stability", F.lit(1.0))).alias("s"))
    notes = F.filter(F.array(F.when(F.col("c") < 0.9, "incomplete"), F.when(F.col("i") < 0.99, "implausible values"), F.when(F.col("s") < 0.7, "unstable")), lambda x: x.isNotNull())
    return means.select("source_id", rounded(0.5 * F.col("c") + 0.2 * F.col("i") + 0.3 * F.col("s"), 4).alias("reliability"), rounded("c", 4).alias("completeness"), rounded("i", 4).alias("integrity"), rounded("s", 4).alias("stability"), F.array_join(notes, "; ").alias("notes"))


def missing_ratio(signals: DataFrame) -> DataFrame:
    """(district_id, date, missing_ratio): signal types absent that day among those of the whole input."""
    types = signals.agg(F.countDistinct("signal_type").alias("_all"))
    daily = signals.where("value is not null").groupBy("district_id", "date").agg(F.countDistinct("signal_type").alias("_n"))
    every = signals.select("district_id", "date").distinct().join(daily, ["district_id", "date"], "left")
    return every.crossJoin(F.broadcast(types)).select("district_id", "date", F.greatest(F.lit(0.0), 1 - F.coalesce("_n", F.lit(0)) / F.col("_all")).alias("missing_ratio"))


def outlier_ratio(signals: DataFrame, limit: float = 6.0) -> DataFrame:
    """(district_id, date, outlier_ratio): values far from the day's median over all types; missing values count as rows."""
    z = group_robust_z(signals, ["district_id", "date"])
    return z.groupBy("district_id", "date").agg(F.avg(F.when(F.abs("rz") > limit, 1.0).otherwise(0.0)).alias("outlier_ratio"))


def district_drift(signals: DataFrame) -> DataFrame:
    """(district_id, drift_score): mean PSI over signals of at least 20 rows, the last quarter against the rest."""
    keys = ["district_id", "signal_type"]
    w = Window.partitionBy(*keys)
    placed = signals.where("value is not null").withColumns({"_k": F.row_number().over(w.orderBy("date", "source_id")), "_n": F.count("*").over(w)}).where("_n >= 20")
    split = placed.withColumn("_recent", F.col("_k") > F.floor(F.col("_n") * 0.75))
    found = psi(split, keys, "_recent").groupBy("district_id").agg(F.avg("psi").alias("drift_score"))
    return signals.select("district_id").distinct().join(found, "district_id", "left").select("district_id", F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"))


def daily_confidence(signals: DataFrame) -> DataFrame:
    """(district_id, date, confidence, missing_ratio, outlier_ratio): mean reliability of the sources, less for missing types and outliers."""
    mean = source_reliability(signals).agg(F.avg("reliability").alias("_r"))
    cells = missing_ratio(signals).join(outlier_ratio(signals), ["district_id", "date"]).crossJoin(F.broadcast(mean))
    confidence = clamp(F.col("_r") * (1 - 0.6 * F.col("missing_ratio")) * (1 - 0.3 * F.col("outlier_ratio")))
    return cells.select("district_id", "date", rounded(confidence, 4).alias("confidence"), "missing_ratio", "outlier_ratio")


def quality_report(signals: DataFrame) -> DataFrame:
    """(district_id, date, confidence, missing_ratio, outlier_ratio, drift_score). Drift is reported and not used."""
    cells = daily_confidence(signals).join(district_drift(signals), "district_id")
    return cells.select("district_id", "date", "confidence", rounded("missing_ratio", 4).alias("missing_ratio"), rounded("outlier_ratio", 4).alias("outlier_ratio"), rounded("drift_score", 4).alias("drift_score"))


def latest_confidence(report: DataFrame) -> DataFrame:
    return report.groupBy("district_id").agg(F.max_by("confidence", "date").alias("confidence"))


def drift_report(agg: DataFrame) -> DataFrame:
    """(signal_type, psi, drift): daily means over districts, at least 30 days, the last fifth against the rest."""
    # Rounded, so that a mean's last bits can't move it across a quantile edge.
    daily = agg.groupBy("signal_type", "date").agg(rounded(F.avg("value"), 6).alias("value"))
    w = Window.partitionBy("signal_type")
    placed = daily.withColumns({"_k": F.row_number().over(w.orderBy("date")), "_n": F.count("*").over(w)}).where("_n >= 30")
    found = psi(placed.withColumn("_recent", F.col("_k") > F.floor(F.col("_n") * 0.8)), ["signal_type"], "_recent")
    return found.select("signal_type", rounded("psi", 4).alias("psi"), drift_band("psi").alias("drift"), (F.col("psi") >= 0.25).alias("retrain"))
