"""The test tables as signals: daily events, weekly order lines, districts and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event type, an order priority, a market segment and a return flag stand for.
EVENT_SIGNALS = {"click": "search_fever", "view": "search_cough", "signup": "hospital_admissions", "error": "wastewater_viral_load", "purchase": "social_mentions"}
PRIORITY_SIGNALS = {"1-URGENT": "search_fever", "2-HIGH": "search_cough", "3-MEDIUM": "search_rash", "4-NOT SPECIFIED": "search_vomiting", "5-LOW": "search_diarrhea"}
SEGMENT_SIGNALS = {"BUILDING": "hospital_admissions", "AUTOMOBILE": "icu_occupancy", "MACHINERY": "ventilator_usage", "HOUSEHOLD": "mortality", "FURNITURE": "lab_pcr_requests"}
FLAG_SIGNALS = {"R": "social_mentions", "A": "wastewater_viral_load", "N": "weather_humidity"}
#: Signals that a nation's pulse raises, by nation key modulo 5; others stay as they are.
PULSED = {
    0: ("search_fever", "search_rash", "hospital_admissions", "social_mentions"),
    1: ("search_fever", "search_cough", "hospital_admissions", "icu_occupancy", "ventilator_usage", "wastewater_viral_load"),
    2: ("search_diarrhea", "search_vomiting", "hospital_admissions", "lab_pcr_requests", "wastewater_viral_load"),
    3: ("search_vomiting", "search_diarrhea", "mortality", "social_mentions"),
}
PULSE = 2.5


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _named(values: dict[str, str], key):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation_key, district_id, region): nations with their region."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    joined = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("district_id"), F.col("r_name").alias("region"))


def daily_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, district_id, date, signal_type, value, source_id): mean event value by customer's nation, day, type and source."""
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    homes = customer.join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("nation_key"))
    joined = events.join(homes, F.col("user_id") == F.col("c_custkey"))
    keyed = joined.select("region", "district_id", F.to_date("ts").alias("date"), _named(EVENT_SIGNALS, F.col("event_type")).alias("signal_type"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source_id"))
    grouped = keyed.groupBy("region", "district_id", "date", "signal_type", "source_id").agg((F.sum("cents") / F.count("*") / 100).alias("value"))
    return grouped.select("region", "district_id", "date", "signal_type", "value", "source_id")


def weekly_signals(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    """(region, district_id, date, signal_type, value), and source_id if asked for: every order line counts towards its priority's, its
    segment's and its flag's signal and two weather signals in one shuffle; a deterministic pulse raises some signals in the last weeks."""
    return signals_of(weekly_cells(spark, sf_dir, by_source), by_source)


def weekly_cells(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    """(region, district_id, nation_key, date, signal_type, h, n), and source_id if asked for: sums of hundredths and numbers of lines, which add up over sources."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    homes = customer.join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("nation_key"))
    bought = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    hundredths = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    pairs = F.array(
        F.struct(_named(PRIORITY_SIGNALS, F.col("o_orderpriority")).alias("signal_type"), hundredths("l_quantity").alias("h")),
        F.struct(_named(SEGMENT_SIGNALS, F.col("c_mktsegment")).alias("signal_type"), hundredths("l_quantity").alias("h")),
        F.struct(_named(FLAG_SIGNALS, F.col("l_returnflag")).alias("signal_type"), hundredths("l_quantity").alias("h")),
        F.struct(F.lit("weather_temp").alias("signal_type"), (hundredths("l_discount") * 100).alias("h")),
        F.struct(F.lit("weather_rainfall").alias("signal_type"), (hundredths("l_tax") * 100).alias("h")),
    )
    own = ["source_id"] if by_source else []
    source = F.concat(F.lit("src"), (F.col("l_orderkey") % 3).cast("string")).alias("source_id")
    counted = joined.select("region", "district_id", "nation_key", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.explode(pairs).alias("x"), *([source] if by_source else []))
    return counted.groupBy("region", "district_id", "nation_key", "date", F.col("x.signal_type").alias("signal_type"), *own).agg(F.sum("x.h").alias("h"), F.count("*").alias("n"))


def signals_of(counted: DataFrame, by_source: bool = False) -> DataFrame:
    """The weekly signals of such cells, over all sources or by source."""
    own = ["source_id"] if by_source else []
    cells = counted.groupBy("region", "district_id", "nation_key", "date", "signal_type", *own).agg((F.sum("h") / F.sum("n") / 100).alias("value"))
    last = cells.agg(F.max("date").alias("last"))
    week = 11 - F.floor(F.datediff("last", "date") / 7)
    raised = F.lit(False)
    for key, signals in PULSED.items():
        raised = raised | ((F.col("nation_key") % 5 == key) & F.col("signal_type").isin(*signals))
    pulse = F.when(raised & (week >= 0), 1 + PULSE / (1 + (week - 5) * (week - 5) / 9.0)).otherwise(1.0)
    return cells.where("signal_type is not null").crossJoin(F.broadcast(last)).select("region", "district_id", "date", "signal_type", (F.col("value") * pulse).alias("value"), *own)


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district_id, name, region, population, lat, lon, neighbors): a ring of neighbours in each region."""
    people = read(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg((F.count("*") * 10000).alias("population"))
    base = places(spark, sf_dir).join(people, F.col("nation_key") == F.col("c_nationkey"), "left")
    placed = base.select("district_id", F.concat(F.lit("District "), F.col("nation_key").cast("string")).alias("name"), "region", F.coalesce("population", F.lit(10000)).alias("population"), (F.col("nation_key") % 5 * 0.7 + 10).alias("lat"), (F.floor(F.col("nation_key") / 5) * 0.9 + 70).alias("lon"), "nation_key")
    names = F.transform(F.array(F.pmod(F.col("nation_key") + 5, F.lit(25)), F.pmod(F.col("nation_key") + 20, F.lit(25))), lambda k: F.concat(F.lit("NATION_"), k.cast("string")))
    return placed.withColumn("neighbors", names).drop("nation_key")
