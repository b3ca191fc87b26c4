"""Roll-ups, snapshots, pages and rankings that dashboards read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import level_order, rounded


def risk_timeline(risk: DataFrame) -> DataFrame:
    """(date, mean_risk, max_risk): risk has two decimals, so hundredths add up to the same mean in any order."""
    hundredths = F.floor(F.col("risk_score") * 100 + 0.5).cast("long")
    return risk.groupBy("date").agg(rounded(F.sum(hundredths) / F.count("risk_score") / 100, 2).alias("mean_risk"), rounded(F.max("risk_score"), 2).alias("max_risk"))


def signal_daily_mean(agg: DataFrame, district_id: str) -> DataFrame:
    return agg.where(F.col("district_id") == district_id).groupBy("signal_type", "date").agg(rounded(F.avg("value"), 3).alias("value"))


def national_rollup(latest: DataFrame) -> DataFrame:
    """A row for each region and one for all (region null): districts, elevated ones, alerts, and the top district with its risk."""
    elevated, alerts = level_order("level") >= 1, level_order("level") >= 3
    top = F.max(F.struct("risk_score", F.col("district_id")))
    return latest.rollup("region").agg(F.count("*").alias("n_districts"), F.count_if(elevated).alias("n_elevated"), F.count_if(alerts).alias("n_alerts"), top["district_id"].alias("top_district"), top["risk_score"].alias("top_risk"))


def top_risk(latest: DataFrame, n: int = 10) -> DataFrame:
    return latest.orderBy(F.desc("risk_score"), "district_id").limit(n)


def paged(latest: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """A page in risk order; no limit gives the rest, otherwise it lies in 1..1000."""
    if limit is not None and not 1 <= limit <= 1000:
        raise ValueError("limit must be in 1..1000")
    ordered = latest.orderBy(F.desc("risk_score"), "district_id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def snapshot(risk: DataFrame, as_of) -> DataFrame:
    """The rows of one day; a day without rows gives none."""
    return risk.where(F.col("date") == as_of)


def region_meta(latest: DataFrame, districts: DataFrame) -> DataFrame:
    n = districts.groupBy("region").agg(F.count("*").alias("n_districts"), F.sum("population").alias("population"))
    active = latest.where(level_order("level") >= 1).groupBy("region").agg(F.count("*").alias("n_active"))
    return n.join(active, "region", "left").select("region", "n_districts", "population", F.coalesce("n_active", F.lit(0)).alias("n_active"))


def category_distribution(assessed: DataFrame) -> DataFrame:
    return assessed.where(level_order("level") >= 1).groupBy("category").agg(F.count("*").alias("n"))


def level_kpis(latest: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("level") == name).alias(name.lower())
    return latest.agg(F.count("*").alias("districts"), count("Watch"), count("Warning"), count("Alert"), count("Emergency"), rounded(F.max("risk_score"), 2).alias("max_risk"))


def population_rank(districts: DataFrame, k: int) -> DataFrame:
    """Each region's k-th largest district; its last one where it has fewer."""
    w = Window.partitionBy("region")
    ranked = districts.withColumns({"_k": F.row_number().over(w.orderBy(F.desc("population"), "district_id")), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_k") == F.least(F.lit(k), F.col("_n"))).select("region", "district_id", "population")


def recent(events: DataFrame, limit: int = 200) -> DataFrame:
    """The newest rows of an access log; the limit is held to 1..1000."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(1000, limit)))


def catalog(log: DataFrame) -> DataFrame:
    """The current state of an append-only artifact log: rows and time of the last entry of each."""
    return log.groupBy("region", "artifact").agg(F.max_by("rows", "updated_at").alias("rows"), F.max("updated_at").alias("updated_at"))


def registry_latest(log: DataFrame) -> DataFrame:
    """(name, version, n_versions, created_at): versions count up by time, and the last is the highest number."""
    w = Window.partitionBy("name")
    numbered = log.withColumns({"version": F.row_number().over(w.orderBy("created_at", "run")), "n_versions": F.count("*").over(w)})
    return numbered.where("version = n_versions").select("name", F.concat(F.lit("v"), F.col("version").cast("string")).alias("version"), "n_versions", "created_at")


def spread_outlook(forecasts: DataFrame, latest: DataFrame, k: int = 4) -> DataFrame:
    """Districts that are calm now with the highest probability at the last horizon, k a region."""
    last = forecasts.groupBy("region", "district_id").agg(F.max_by("risk_probability", "horizon_days").alias("prob"))
    calm = last.join(latest.where(level_order("level") >= 1).select("district_id"), "district_id", "left_anti")
    w = Window.partitionBy("region").orderBy(F.desc("prob"), "district_id")
    return calm.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("region", "district_id", "prob", "rank")
