"""District geometry from GeoJSON: ring areas, derived districts and shared boundaries.

Each operator takes `by`, further columns that keep places apart, such as the region: all regions go through one plan of one size.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpost.sources.shared import written

FEATURE = "properties struct<district: string>, geometry struct<type: string, coordinates: array<array<array<array<double>>>>>"


def rings(features: DataFrame, column: str = "feature", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, district_id, ring, pos, x, y): points of all rings of MultiPolygon features."""
    parsed = features.select(*by, F.from_json(column, FEATURE).alias("f"))
    flat = parsed.select(*by, F.col("f.properties.district").alias("district_id"), F.flatten("f.geometry.coordinates").alias("rings"))
    each = flat.select(*by, "district_id", F.posexplode("rings").alias("ring", "points"))
    return each.select(*by, "district_id", "ring", F.posexplode("points").alias("pos", "p")).select(*by, "district_id", "ring", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def ring_area(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, district_id, ring, n_points, area, lon, lat): shoelace with longitudes scaled by the cosine of the ring's mean latitude.
    Under three points, or no area, give area 0 and the first point."""
    key = [*by, "district_id", "ring"]
    scaled = points.withColumn("_s", F.cos(F.radians(F.avg("y").over(Window.partitionBy(*key)))))
    w = Window.partitionBy(*key).orderBy("pos")
    x1, y1, x2, y2 = F.col("x") * F.col("_s"), F.col("y"), F.lead("x").over(w) * F.col("_s"), F.lead("y").over(w)
    sides = scaled.select(*key, "pos", "x", "y", "_s", (x1 * y2 - x2 * y1).alias("c"), (x1 + x2).alias("sx"), (y1 + y2).alias("sy"))
    sums = sides.groupBy(*key).agg(F.count("*").alias("n"), (F.sum("c") * 0.5).alias("a"), F.sum(F.col("sx") * F.col("c")).alias("cx"), F.sum(F.col("sy") * F.col("c")).alias("cy"), F.first("_s").alias("s"), F.min_by("x", "pos").alias("x0"), F.min_by("y", "pos").alias("y0"))
    flat = (F.col("n") < 3) | (F.abs("a") < 1e-12)
    return sums.select(*key, F.col("n").alias("n_points"), F.when(flat, 0.0).otherwise(F.abs("a")).alias("area"), F.when(flat, F.col("x0")).otherwise(F.col("cx") / (6 * F.col("a")) / F.col("s")).alias("lon"), F.when(flat, F.col("y0")).otherwise(F.col("cy") / (6 * F.col("a"))).alias("lat"))


def derived_districts(areas: DataFrame, total_population: int | Column | str, least: int = 50_000, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, district_id, area, lon, lat, population): areas of all rings add up, the ring with most points gives the centre, and
    population follows area, at least `least`. total_population: a number for all, or a column of areas with one value for each `by`."""
    people = F.lit(total_population) if isinstance(total_population, int) else total_population if isinstance(total_population, Column) else F.col(total_population)
    biggest = F.struct("n_points", (-F.col("ring")).alias("r"))
    merged = areas.groupBy(*by, "district_id").agg(F.sum("area").alias("area"), F.max_by("lon", biggest).alias("lon"), F.max_by("lat", biggest).alias("lat"), F.max(people).alias("_people"))
    whole = merged.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("area").alias("_all"))
    share = F.col("area") / F.when(F.col("_all") > 0, F.col("_all")).otherwise(1.0)
    joined = merged.join(whole, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])) if by else merged.crossJoin(F.broadcast(whole))
    return joined.select(*by, "district_id", "area", "lon", "lat", F.greatest(F.lit(least), (share * F.col("_people")).cast("long")).alias("population"))


def boundary_adjacency(points: DataFrame, shared: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, u, v): districts that share at least `shared` points of three decimals, u < v: a join on the points, not on pairs. Districts of
    equal points are one outline: only outlines are joined and counted, and what they share is dealt to their districts without a shuffle of pairs."""
    at = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    placed = points.select(*by, "district_id", at("x").alias("px"), at("y").alias("py")).where("district_id is not null and px is not null and py is not null")
    drawn = placed.groupBy(*by, "district_id").agg(F.array_sort(F.collect_set(F.struct("px", "py"))).alias("_points"))
    known = written(drawn)
    # An outline goes by its least district, so that its points don't travel with its districts.
    first = written(known.groupBy(*by, "_points").agg(F.min("district_id").alias("_outline")))
    unique = first.select(*by, "_outline", F.explode("_points").alias("p")).select(*by, "_outline", "p.px", "p.py")
    other = unique.withColumnRenamed("_outline", "_b")
    pairs = unique.withColumnRenamed("_outline", "_a").join(other, [*by, "px", "py"]).where("_a <= _b")
    met = written(pairs.groupBy(*by, "_a", "_b").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= shared))
    members = written(known.join(first, [*by, "_points"]).select(*by, "_outline", "district_id"))
    left = met.join(members.select(*by, F.col("_outline").alias("_a"), F.col("district_id").alias("_x")), [*by, "_a"])
    both = left.join(members.select(*by, F.col("_outline").alias("_b"), F.col("district_id").alias("_y")), [*by, "_b"])
    return both.where("_x < _y or (_a <> _b and _x <> _y)").select(*by, F.least("_x", "_y").alias("u"), F.greatest("_x", "_y").alias("v"), "n_shared")
