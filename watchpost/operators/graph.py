"""District graphs: gravity edges, normalised adjacency, neighbour features and spread forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import rounded
from watchpost.sources.shared import written

HORIZONS = (7, 14, 21, 30)
INTRINSIC, BETA = 0.04, 0.085
DAYS_AT_ONCE = 7


def adjacency(districts: DataFrame) -> DataFrame:
    """(u, v): each pair of neighbours once, u < v; names that are no district drop out."""
    pairs = districts.select("district_id", F.explode("neighbors").alias("other")).select(F.least("district_id", "other").alias("u"), F.greatest("district_id", "other").alias("v")).where("u <> v").distinct()
    known = districts.select(F.col("district_id").alias("v"))
    return pairs.join(known, "v", "left_semi").join(known.withColumnRenamed("v", "u"), "u", "left_semi").select("u", "v")


def gravity_edges(districts: DataFrame) -> DataFrame:
    """(region, u, v, weight): population products over squared great-circle distance of at least 1 km, over the region's maximum."""
    a = districts.select(F.col("district_id").alias("u"), "region", F.col("population").alias("pa"), F.radians("lat").alias("la"), F.radians("lon").alias("oa"))
    b = districts.select(F.col("district_id").alias("v"), F.col("population").alias("pb"), F.radians("lat").alias("lb"), F.radians("lon").alias("ob"))
    joined = adjacency(districts).join(a, "u").join(b, "v")
    sine = lambda x: F.sin(x / 2) * F.sin(x / 2)
    h = sine(F.col("lb") - F.col("la")) + F.cos("la") * F.cos("lb") * sine(F.col("ob") - F.col("oa"))
    km = F.greatest(F.lit(1.0), 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))
    pulled = joined.select("region", "u", "v", (F.col("pa").cast("double") * F.col("pb") / (km * km)).alias("g"))
    return pulled.select("region", "u", "v", (F.col("g") / F.max("g").over(Window.partitionBy("region"))).alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("region", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def normalized_adjacency(districts: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, a): D^-1/2 (W + I) D^-1/2."""
    loops = districts.select("region", F.col("district_id").alias("u"), F.col("district_id").alias("v"), F.lit(1.0).alias("weight"))
    whole = mirrored(edges).unionByName(loops)
    degree = whole.groupBy("u").agg(F.sum("weight").alias("d"))
    return whole.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").select("u", "v", (F.col("weight") / F.sqrt("d") / F.sqrt("dv")).alias("a"))


def neighbor_features(normal: DataFrame, features: DataFrame) -> DataFrame:
    """(district_id, risk, pop): one hop of the features over the normalised adjacency."""
    joined = normal.join(features, normal["v"] == features["district_id"])
    return joined.groupBy(normal["u"].alias("district_id")).agg(rounded(F.sum(F.col("a") * F.col("risk")), 6).alias("risk"), rounded(F.sum(F.col("a") * F.col("pop")), 6).alias("pop"))


def spread_forecast(latest: DataFrame, districts: DataFrame, edges: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(region, district_id, horizon_days, risk_probability): daily diffusion. A day is a join of the edges with the probabilities of
    their far ends, summed by district, so that a region of any size is split as Spark splits joins. The state is written
    every DAYS_AT_ONCE days, which bounds the lineage. Districts without a risk start at 0."""
    start = districts.select("region", "district_id").join(latest.select("district_id", "risk_score"), "district_id", "left")
    state = written(start.select("region", "district_id", (F.coalesce("risk_score", F.lit(0.0)) / 100).alias("p")))
    # A district is joined with itself too, under no weight, so that one join and one aggregation make a day.
    itself = state.select("region", "district_id", F.col("district_id").alias("other"), F.lit(None).cast("double").alias("weight"))
    near = written(itself.unionByName(mirrored(edges).select("region", F.col("u").alias("district_id"), F.col("v").alias("other"), "weight")))
    p, pull = F.max(F.when(F.col("weight").isNull(), F.col("p"))), F.coalesce(F.sum(F.col("weight") * F.col("p")), F.lit(0.0))
    after = F.least(F.lit(1.0), F.col("_p") + (1 - F.col("_p")) * (INTRINSIC * F.col("_p") + BETA * F.col("_pull")))
    out = None
    for day in range(1, max(horizons) + 1):
        pulled = near.join(state.select(F.col("district_id").alias("other"), "p"), "other").groupBy("region", "district_id").agg(p.alias("_p"), pull.alias("_pull"))
        state = pulled.select("region", "district_id", after.alias("p"))
        if day in horizons or day % DAYS_AT_ONCE == 0:
            state = written(state)
        if day in horizons:
            own = state.select("region", "district_id", F.lit(day).alias("horizon_days"), rounded("p", 4).alias("risk_probability"))
            out = own if out is None else out.unionByName(own)
    return out


def forecast_rank(forecasts: DataFrame) -> DataFrame:
    """Districts by the probability at the last horizon."""
    last = forecasts.groupBy("region", "district_id").agg(F.max_by("risk_probability", "horizon_days").alias("prob"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("prob"), "district_id")))
