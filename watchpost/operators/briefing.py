"""A briefing for each region: context and Markdown text, built of aggregates and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import level_order
from watchpost.operators.alerts import CATEGORY_ACTIONS, LEVEL_ACTIONS

# The sentences and headings of a briefing.
SUMMARY, CONCERN, OUTLOOK, ACTIONS, SOURCES = "## Executive Summary", "## Districts of Concern", "## 30-Day Spread Outlook", "## Recommended Actions", "## Data Sources"
CALM = ("No districts currently exceed alert thresholds across ", " monitored districts. Surveillance signals are within expected ranges.")
RAISED = " districts are showing elevated outbreak risk."
HIGHEST = " The highest concern is **"
AHEAD = "Districts most likely to see rising risk from current hotspots (network-diffusion forecast):"
BY_DAY_30 = "% probability by day 30"
ROUTINE = "Maintain routine surveillance and weekly signal review."


def briefing_context(assessed: DataFrame, outlook: DataFrame) -> DataFrame:
    """(region, as_of, total, on_alert, top, outlook, actions) from each region's latest assessments (region, district_id,
    district_name, date, risk_score, level, category, likely_diseases): the five highest, calm ones taken out after the cut."""
    w = Window.partitionBy("region").orderBy(F.desc("risk_score"), "district_id")
    ranked = assessed.withColumn("_k", F.row_number().over(w))
    shown = (F.col("_k") <= 5) & (level_order("level") >= 1)
    item = F.struct(F.col("_k").alias("k"), F.col("district_name").alias("name"), F.bround("risk_score", 0).cast("int").alias("risk"), "level", "category", "likely_diseases")
    per_region = ranked.groupBy("region").agg(F.max("date").alias("as_of"), F.count("*").alias("total"), F.count_if(level_order("level") >= 1).alias("on_alert"), F.sort_array(F.collect_list(F.when(shown, item))).alias("top"))
    names = assessed.select("district_id", "district_name")
    ahead = outlook.join(names, "district_id").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("district_name").alias("name"), "prob"))).alias("outlook"))
    by_level = F.create_map(*[F.lit(x) for pair in LEVEL_ACTIONS.items() for x in pair])
    by_category = F.create_map(*[x for c, xs in CATEGORY_ACTIONS.items() for x in (F.lit(c), F.array(*map(F.lit, xs[:2])))])
    lead = F.get("top", F.lit(0))
    actions = F.when(F.size("top") == 0, F.array(F.lit(ROUTINE))).otherwise(F.concat(F.array(by_level[lead["level"]]), by_category[lead["category"]]))
    joined = per_region.join(ahead, "region", "left").withColumn("outlook", F.coalesce("outlook", F.array().cast("array<struct<rank:int,name:string,prob:double>>")))
    return joined.withColumn("actions", actions)


def briefing_text(context: DataFrame) -> DataFrame:
    """(region, as_of, body): sections that have nothing to say are left out. A column data_sources, a map of source to status, is listed
    where the context has one."""
    region, lead = F.col("region"), F.get("top", F.lit(0))
    calm = F.concat(F.lit(CALM[0]), F.col("total").cast("string"), F.lit(CALM[1]))
    highest = F.when(lead.isNotNull(), F.concat(F.lit(HIGHEST), lead["name"], F.lit("** ("), lead["level"], F.lit(", risk "), lead["risk"].cast("string"), F.lit("/100, likely "), F.lower(lead["category"]), F.lit(")."))).otherwise("")
    raised = F.concat(F.lit("**"), F.col("on_alert").cast("string"), F.lit("** of "), F.col("total").cast("string"), F.lit(RAISED), highest)
    concern = F.transform("top", lambda x: F.concat(F.lit("- **"), x["name"], F.lit("** — "), x["level"], F.lit(", risk "), x["risk"].cast("string"), F.lit("/100 ("), x["category"], F.lit(")"), F.when(x["likely_diseases"] != "", F.concat(F.lit(" — likely: "), x["likely_diseases"])).otherwise("")))
    ahead = F.transform("outlook", lambda x: F.concat(F.lit("- **"), x["name"], F.lit("** — "), F.bround(x["prob"] * 100, 0).cast("int").cast("string"), F.lit(BY_DAY_30)))
    numbered = F.transform("actions", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n"), F.lit("\n")))
    listed = []
    if "data_sources" in context.columns:
        named = F.transform(F.array_sort(F.map_entries("data_sources")), lambda x: F.concat(x["key"], F.lit(" ("), x["value"], F.lit(")")))
        listed.append(F.when(F.size(named) > 0, F.concat(F.lit(SOURCES + "\n"), F.array_join(named, ", "), F.lit("\n"))))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), region, F.lit(" Health Intelligence Briefing")),
        F.concat(F.lit("_As of "), F.date_format("as_of", "yyyy-MM-dd"), F.lit("_\n")),
        F.concat(F.lit(SUMMARY + "\n"), F.when(F.col("on_alert") == 0, calm).otherwise(raised), F.lit("\n")),
        section(CONCERN, concern),
        section(f"{OUTLOOK}\n{AHEAD}", ahead),
        section(ACTIONS, numbered),
        *listed,
        F.lit("_Generated from statistical surveillance models; it supports expert judgement and does not replace it._"),
    )
    return context.select("region", "as_of", body.alias("body"))
