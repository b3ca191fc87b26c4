"""Alerts from assessed risk: filter, id, headline, reasons, actions and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import LEVELS, level_order

# Channels by level, cumulative, and the texts of the actions.
CHANNELS = ("dashboard", "email", "sms", "whatsapp")
LEVEL_ACTIONS = {
    "Watch": "Continue monitoring; verify signal with district surveillance officer",
    "Warning": "Activate district surveillance unit; daily situation reporting",
    "Alert": "Convene district rapid-response team; brief health administration",
    "Emergency": "Escalate to State Control Room; activate emergency response plan",
}
CATEGORY_ACTIONS = {
    "Vector": ["Launch vector-control & fogging drives in affected wards", "Eliminate stagnant-water breeding sites; public awareness on dengue prevention", "Pre-position platelet stocks and dengue NS1/IgM test kits"],
    "Respiratory": ["Reinforce mask advisories and respiratory hygiene messaging", "Audit oxygen, ICU and ventilator capacity in district hospitals", "Expand respiratory-panel PCR testing at sentinel sites"],
    "Waterborne": ["Issue boil-water advisory; inspect and chlorinate water supply", "Deploy ORS and IV-fluid stocks to PHCs", "Test drinking-water sources and sewage cross-contamination points"],
    "Foodborne": ["Inspect food vendors and recent common-source events", "Stock ORS/antiemetics at PHCs; trace suspected food source"],
    "Unknown": ["Dispatch rapid-response team for field epidemiological investigation", "Collect samples for syndromic and metagenomic testing"],
}


def alert_filter(assessed: DataFrame, min_level: str = "Watch") -> DataFrame:
    """Rows at `min_level` or above; Normal never is an alert."""
    return assessed.where(level_order("level") >= max(1, LEVELS.index(min_level)))


def ranked(alerts: DataFrame) -> DataFrame:
    """With rank: the order of a day's alerts, most severe first, then by risk; equal ones by district."""
    day = Window.partitionBy("date").orderBy(F.desc(level_order("level")), F.desc("risk_score"), "district_id")
    return alerts.withColumn("rank", F.row_number().over(day))


def alert_id(assessed: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "district_id", F.date_format("date", "yyyy-MM-dd"), "level")
    return assessed.withColumn("alert_id", F.substring(F.sha1(key), 1, 12))


def headline(assessed: DataFrame) -> DataFrame:
    whole = F.bround("risk_score", 0).cast("int").cast("string")
    return assessed.withColumn("headline", F.concat("level", F.lit(": possible "), F.lower("category"), F.lit(" outbreak in "), "district_name", F.lit(" (risk "), whole, F.lit("/100)")))


def actions(assessed: DataFrame) -> DataFrame:
    """With actions, an array: the level's, then the category's."""
    by_level = F.create_map(*[F.lit(x) for pair in LEVEL_ACTIONS.items() for x in pair])
    by_category = F.create_map(*[x for c, xs in CATEGORY_ACTIONS.items() for x in (F.lit(c), F.array(*map(F.lit, xs)))])
    none = F.array().cast("array<string>")
    return assessed.withColumn("actions", F.concat(F.array_compact(F.array(by_level[F.col("level")])), F.coalesce(by_category[F.col("category")], none)))


def channels(assessed: DataFrame) -> DataFrame:
    return assessed.withColumn("channels", F.slice(F.array(*map(F.lit, CHANNELS)), F.lit(1), level_order("level")))


def reasons(assessed: DataFrame, contributions: DataFrame, top: int = 5) -> DataFrame:
    """With reasons, an array: the first contributions with their detail, then the likely diseases."""
    parts = contributions.join(assessed.select("district_id", "date"), ["district_id", "date"], "left_semi")
    shown = parts.groupBy("district_id", "date").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", "label", F.nullif("detail", F.lit(""))).alias("t")))), lambda x: x["t"]), 1, top).alias("_parts"))
    likely = F.when(F.col("likely_diseases") != "", F.array(F.concat(F.lit("Most likely: "), "likely_diseases"))).otherwise(F.array().cast("array<string>"))
    return assessed.join(shown, ["district_id", "date"], "left").withColumn("reasons", F.concat(F.coalesce("_parts", F.array().cast("array<string>")), likely)).drop("_parts")


def distinct_actions(alerts: DataFrame, top: int = 6) -> DataFrame:
    """(action): each action once, in the order of the alerts by severity and risk, then within an alert."""
    spread = alerts.select(F.posexplode("actions").alias("pos", "action"), level_order("level").alias("o"), "risk_score", "district_id")
    first = spread.groupBy("action").agg(F.min(F.struct((-F.col("o")).alias("o"), (-F.col("risk_score")).alias("r"), "district_id", "pos")).alias("k"))
    return first.orderBy("k").limit(top).select("action")
