"""Variant shares: normalisation, current mix, emerging variants and share-weighted multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import rounded

# Transmissibility and severity of each variant against the baseline.
VARIANTS = {"denv1": (1.00, 1.00), "denv2": (1.05, 1.10), "denv3": (1.00, 1.00), "denvx": (1.40, 1.30)}


def variant_shares(counts: DataFrame) -> DataFrame:
    """(region, date, variant, share): counts, at least 0, over the day's total."""
    x = F.greatest(F.lit(0.0), F.col("n").cast("double"))
    return counts.select("region", "date", "variant", (x / F.nullif(F.sum(x).over(Window.partitionBy("region", "date")), F.lit(0.0))).alias("share"))


def variant_mix(shares: DataFrame) -> DataFrame:
    return shares.groupBy("region", "variant").agg(rounded(F.max_by("share", "date"), 4).alias("share"))


def emerging_variants(shares: DataFrame, window: int = 60, slope: float = 0.10, least: float = 0.20) -> DataFrame:
    """Variants of more than `window` rows that rose by `slope` against the row `window` - 1 before the last and are common now."""
    by = Window.partitionBy("region", "variant").orderBy("date")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = shares.withColumns({"_past": F.lag("share", window - 1).over(by), "_k": F.row_number().over(by), "_n": F.count("*").over(whole)}).where("_k = _n")
    rise = F.col("share") - F.col("_past")
    return last.where((F.col("_n") > window) & (rise >= slope) & (F.col("share") >= least)).select("region", "variant", rounded("share", 4).alias("current_share"), rounded(rise, 4).alias("slope"))


def variant_series(shares: DataFrame) -> DataFrame:
    wide = shares.groupBy("region", "date").pivot("variant", list(VARIANTS)).agg(F.max("share"))
    return wide.select("region", "date", *[rounded(v, 4).alias(v) for v in VARIANTS])


def variant_multiplier(mix: DataFrame) -> DataFrame:
    """(region, transmissibility, severity): multipliers weighted by share; no share at all counts as a total of 1."""
    table = mix.sparkSession.createDataFrame([(k, *v) for k, v in VARIANTS.items()], "variant string, t double, s double")
    total = F.coalesce(F.nullif(F.sum("share"), F.lit(0.0)), F.lit(1.0))
    joined = mix.join(F.broadcast(table), "variant")
    return joined.groupBy("region").agg(rounded(F.sum(F.col("share") * F.col("t")) / total, 4).alias("transmissibility"), rounded(F.sum(F.col("share") * F.col("s")) / total, 4).alias("severity"))
