"""Robust statistics over series: trailing z-scores, seasonal residuals, baselines, group z-scores, PSI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.functions.kernels import trailing

SERIES = ("district_id", "signal_type")


def rolling_robust_z(df: DataFrame, value: str = "value", out: str = "z", window: int = 42, least: int = 14, keys=SERIES) -> DataFrame:
    """Adds a trailing z: distance from the rolling median over the rolling MAD of each row's own distance (pop. deviation
    where the MAD is 0 or absent). Every stage needs `least` rows; no scale gives 0."""
    return trailing(df, list(keys), value, window=window, least=least, z=out)


def deseasonal_z(df: DataFrame, value: str = "value", out: str = "z", period: int = 7, window: int = 42, keys=SERIES) -> DataFrame:
    """Our own seasonal adjustment: a centred mean trend over `period` rows, the median of what is left by place in the cycle,
    centred to mean zero, taken off; then the trailing z. Series under 16 rows keep their values."""
    w, whole = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys)
    half = period // 2
    placed = df.withColumns({
        "_n": F.count(F.lit(1)).over(whole),
        "_place": (F.row_number().over(w) - 1) % period,
        "_off": F.col(value) - F.avg(value).over(w.rowsBetween(-half, half)),
    })
    cycle = placed.groupBy(*keys, "_place").agg(F.percentile("_off", F.lit(0.5)).alias("_cycle"))
    centred = cycle.withColumn("_cycle", F.col("_cycle") - F.avg("_cycle").over(whole))
    adjusted = placed.join(centred, [*keys, "_place"], "left").withColumn("_adj", F.when(F.col("_n") >= 16, F.col(value) - F.col("_cycle")).otherwise(F.col(value)))
    return rolling_robust_z(adjusted, "_adj", out, window, keys=keys).drop("_n", "_place", "_off", "_cycle", "_adj")


def pct_vs_baseline(df: DataFrame, window: int = 42, least: int = 10) -> DataFrame:
    """Adds baseline, the median of the rows before this one, and pct, the change against it in percent."""
    return against_baseline(trailing(df, list(SERIES), window=window, base_least=least, z=None, baseline="baseline"))


def against_baseline(with_base: DataFrame) -> DataFrame:
    return with_base.withColumn("pct", (F.col("value") - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0)) * 100)


def group_robust_z(df: DataFrame, keys: list[str], value: str = "value", out: str = "rz") -> DataFrame:
    """Adds 0.6745 (v - median) / MAD over the group; (v - median) / pop. deviation where the MAD is 0; 0 where both are."""
    first = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_med"), F.stddev_pop(value).alias("_std"))
    off = df.join(first, keys).withColumn("_dev", F.col(value) - F.col("_med"))
    mad = off.groupBy(*keys).agg(F.percentile(F.abs("_dev"), F.lit(0.5)).alias("_mad"))
    z = F.when(F.col("_mad") > 0, 0.6745 * F.col("_dev") / F.col("_mad")).when(F.col("_std") > 0, F.col("_dev") / F.col("_std")).otherwise(0.0)
    return off.join(mad, keys).withColumn(out, F.when(F.col(value).isNotNull(), z)).drop("_med", "_std", "_dev", "_mad")


def psi(df: DataFrame, keys: list[str], is_recent: str, value: str = "value", bins: int = 10, least: int = 10) -> DataFrame:
    """(keys, psi): population stability of recent values against quantile bins of the others; 0 with under `least` of either."""
    quantiles = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    base = df.where(~F.col(is_recent))
    edges = base.groupBy(*keys).agg(F.percentile(value, quantiles).alias("_edges"))
    binned = df.join(edges, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col(value))))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.count(F.when(~F.col(is_recent), F.col(value))).alias("_b"), F.count(F.when(F.col(is_recent), F.col(value))).alias("_r"))
    whole = Window.partitionBy(*keys)
    shares = per_bin.withColumns({"_nb": F.sum("_b").over(whole), "_nr": F.sum("_r").over(whole)})
    b = F.greatest(F.col("_b") / F.col("_nb"), F.lit(1e-6))
    r = F.greatest(F.col("_r") / F.col("_nr"), F.lit(1e-6))
    found = shares.groupBy(*keys).agg(F.sum((r - b) * F.log(r / b)).alias("_psi"), F.first("_nb").alias("_nb"), F.first("_nr").alias("_nr"))
    return found.select(*keys, F.when((F.col("_nb") < least) | (F.col("_nr") < least), 0.0).otherwise(F.col("_psi")).alias("psi"))
