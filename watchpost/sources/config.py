"""Region configuration, a JSON file or folder, as dimension tables.

Each line, or each file read as a whole, is one region: its key, name, and either districts or a GeoJSON file that districts are derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.functions.scoring import slug
from watchpost.operators import geo

REGION = "region string, name string, geojson string, total_population long, districts array<struct<id: string, name: string, state: string, population: long, lat: double, lon: double, neighbors: array<string>>>"


def read_regions(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    return spark.read.schema(REGION).json(path, multiLine=whole_files).where("region is not null")


def region_dim(config: DataFrame) -> DataFrame:
    """(region, name, geojson, n_districts): n_districts is null where districts are to be derived."""
    return config.select("region", F.coalesce("name", "region").alias("name"), "geojson", F.when(F.col("districts").isNotNull(), F.size("districts")).alias("n_districts"))


def district_dim(config: DataFrame) -> DataFrame:
    """(region, district_id, name, state, population, lat, lon, neighbors) of the districts listed; the id is the name's slug where missing."""
    each = config.select("region", F.explode("districts").alias("d"))
    none = F.array().cast("array<string>")
    return each.select("region", F.coalesce("d.id", slug("d.name")).alias("district_id"), F.coalesce("d.name", "d.id").alias("name"), "d.state", F.coalesce("d.population", F.lit(0)).alias("population"), "d.lat", "d.lon", F.coalesce("d.neighbors", none).alias("neighbors"))


def derived_dim(config: DataFrame, features: DataFrame) -> DataFrame:
    """The same for regions without listed districts, from (region, feature JSON): population by share of area, neighbours by boundary. All
    regions go through one plan."""
    by = ("region",)
    people = config.where("districts is null").groupBy("region").agg(F.max(F.coalesce("total_population", F.lit(0))).alias("people"))
    points = geo.rings(features.join(people.select("region"), "region", "left_semi"), by=by)
    placed = geo.derived_districts(geo.ring_area(points, by=by).join(people, "region"), "people", by=by)
    both = geo.boundary_adjacency(points, by=by)
    near = both.select("region", F.col("u").alias("district_id"), F.col("v").alias("o")).unionByName(both.select("region", F.col("v").alias("district_id"), F.col("u").alias("o")))
    near = near.groupBy("region", "district_id").agg(F.array_sort(F.collect_set("o")).alias("neighbors"))
    found = placed.join(near, ["region", "district_id"], "left")
    return found.select("region", "district_id", F.col("district_id").alias("name"), F.lit(None).cast("string").alias("state"), F.col("population").cast("long").alias("population"), "lat", "lon", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))


def dangling_neighbors(districts: DataFrame) -> DataFrame:
    """(district_id, neighbor) that name no district."""
    named = districts.select("district_id", F.explode("neighbors").alias("neighbor"))
    return named.join(districts.select(F.col("district_id").alias("neighbor")), "neighbor", "left_anti").select("district_id", "neighbor")
