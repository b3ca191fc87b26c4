"""Aggregated signals: one value for each district, day and type, and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("district_id", "date", "signal_type")
# The signal types, in order.
SIGNAL_TYPES = ("hospital_admissions", "icu_occupancy", "ventilator_usage", "mortality", "lab_pcr_requests", "search_fever", "search_cough", "search_rash", "search_vomiting", "search_diarrhea", "social_mentions", "wastewater_viral_load", "weather_temp", "weather_humidity", "weather_rainfall")


def weighted_source_mean(signals: DataFrame, reliability: DataFrame) -> DataFrame:
    """(district_id, date, signal_type, value): mean over sources by reliability, at least 1e-3 and 1 for unknown sources.
    Missing values drop from the numerator but keep their weight; a cell of missing values gives 0; rows without a key go. Weights
    count with four decimals and values with eight, in exact sums, so that no order of rows changes a mean; what no decimal
    holds (infinite, or from 1e20) is missing."""
    weights = reliability.select("source_id", F.greatest("reliability", F.lit(1e-3)).alias("_w"))
    kept = signals.where("district_id is not null and date is not null and signal_type is not null")
    joined = kept.join(weights, "source_id", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0))).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    weight, value = F.col("_w").cast("decimal(5,4)"), F.col("value").try_cast("decimal(28,8)")
    total = F.coalesce(F.sum(weight * value).cast("double"), F.lit(0.0))
    return joined.groupBy(*CELL).agg((total / F.sum(weight).cast("double")).alias("value"))


def pivot_signals(agg: DataFrame, types: tuple[str, ...] = SIGNAL_TYPES) -> DataFrame:
    """A row for each district and day, a column for each type; duplicates are averaged."""
    return agg.groupBy("district_id", "date").pivot("signal_type", list(types)).agg(F.avg("value"))


def unpivot_signals(wide: DataFrame, types: tuple[str, ...] = SIGNAL_TYPES) -> DataFrame:
    return wide.unpivot(["district_id", "date"], list(types), "signal_type", "value").where("value is not null")


def district_series(agg: DataFrame, district_id: str, signal_type: str) -> DataFrame:
    return agg.where((F.col("district_id") == district_id) & (F.col("signal_type") == signal_type)).select("date", "value").orderBy("date")
