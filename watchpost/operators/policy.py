"""Alert policies over labelled episodes, and accuracy measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import rounded


def alert_state(risk: DataFrame) -> DataFrame:
    """(district_id, date, bucket, growth, persistent, state): risk tenths, change over three rows in four bands, two rows
    running at 15 or more, and all packed into one number."""
    w = Window.partitionBy("district_id").orderBy("date")
    change = F.coalesce(F.col("risk_score") - F.lag("risk_score", 3).over(w), F.lit(0.0))
    bands = F.when(change < -1, 0).when(change < 1, 1).when(change < 6, 2).otherwise(3)
    twice = ((F.col("risk_score") >= 15) & (F.coalesce(F.lag("risk_score", 1).over(w), F.lit(0.0)) >= 15)).cast("int")
    parts = risk.select("district_id", "date", F.least(F.lit(9), F.floor(F.col("risk_score") / 10)).cast("int").alias("bucket"), bands.alias("growth"), twice.alias("persistent"))
    return parts.withColumn("state", (F.col("bucket") * 4 + F.col("growth")) * 2 + F.col("persistent"))


def policy_backtest(episodes: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: share of outbreaks whose first crossing is at or after the onset (an earlier one is a miss), share of
    other episodes with a crossing, and the mean delay. episodes: (episode, day, risk, is_outbreak, onset)."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    swept = episodes.select("*", grid)
    first = swept.groupBy("threshold", "episode").agg(F.first("is_outbreak").alias("out"), F.first("onset").alias("onset"), F.min(F.when(F.col("risk") >= F.col("threshold"), F.col("day"))).alias("day"))
    hit = F.col("out") & (F.col("day") >= F.col("onset"))
    rate = lambda a, b: rounded(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 3)
    return first.groupBy("threshold").agg(rate(hit, F.col("out")).alias("detection_rate"), rate(~F.col("out") & F.col("day").isNotNull(), ~F.col("out")).alias("false_alarm_rate"), rounded(F.coalesce(F.avg(F.when(hit, F.col("day") - F.col("onset"))), F.lit(0.0)), 2).alias("mean_delay"))


def binary_accuracy(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(rounded(F.avg(((F.col("p") >= 0.5) == F.col("y")).cast("double")), 6).alias("accuracy"))


def forecast_mae(forecasts: DataFrame) -> DataFrame:
    """(n, mae_a, mae_b) of two forecasts against what happened."""
    return forecasts.agg(F.count("*").alias("n"), rounded(F.avg(F.abs(F.col("a") - F.col("actual"))), 4).alias("mae_a"), rounded(F.avg(F.abs(F.col("b") - F.col("actual"))), 4).alias("mae_b"))
