"""Drift from tables that add up: counts of values by day and sums of days, so that a new day reads its own rows only.

value_counts and day_sums of parts of the signals, added up, equal those of the whole: parts can be days, micro-batches or files. The reports read
these tables, whose sizes go by days and by different values, not by rows: edges are quantiles of counted values, and the cut between the
reference and the recent part lies by prefix sums of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpost.functions.scoring import drift_band, rounded
from watchpost.sources.keyed import KeyedTable
from watchpost.sources.shared import scratch

SERIES = ["district_id", "signal_type"]
#: Sums are kept as decimals: added in any order they are the same.
COUNTS = "district_id string, signal_type string, date date, value double, n long"
SUMS = "signal_type string, date date, total decimal(38,8), n long"


def value_counts(signals: DataFrame) -> DataFrame:
    """(district_id, signal_type, date, value, n): how often a day has each value; missing values don't count."""
    return signals.where("value is not null and not isnan(value)").groupBy(*SERIES, "date", "value").agg(F.count("*").alias("n"))


def day_sums(agg: DataFrame) -> DataFrame:
    """(signal_type, date, total, n): sum over all districts, to eight decimals, and number of values."""
    sound = agg.where("value is not null and not isnan(value)")
    return sound.groupBy("signal_type", "date").agg(F.sum(F.col("value").cast("decimal(28,8)")).cast("decimal(38,8)").alias("total"), F.count("*").alias("n"))


def counted_psi(counts: DataFrame, keys: list[str], value: str = "value", bins: int = 10, least: int = 10) -> DataFrame:
    """(keys, psi) from (keys, value, base, recent), numbers of values in either part: 0 with under `least` of one of them."""
    quantiles = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = counts.where("base > 0").groupBy(*keys).agg(F.percentile(value, quantiles, F.col("base")).alias("_edges"))
    binned = counts.join(edges, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col(value))))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("base").alias("_b"), F.sum("recent").alias("_r"))
    whole = Window.partitionBy(*keys)
    shares = per_bin.withColumns({"_nb": F.sum("_b").over(whole), "_nr": F.sum("_r").over(whole)})
    b, r = F.greatest(F.col("_b") / F.col("_nb"), F.lit(1e-6)), F.greatest(F.col("_r") / F.col("_nr"), F.lit(1e-6))
    found = shares.groupBy(*keys).agg(F.sum((r - b) * F.log(r / b)).alias("_psi"), F.first("_nb").alias("_nb"), F.first("_nr").alias("_nr"))
    return found.select(*keys, F.when((F.col("_nb") < least) | (F.col("_nr") < least), 0.0).otherwise(F.col("_psi")).alias("psi"))


def drift_from_sums(sums: DataFrame, recent: float = 0.2, least: int = 30) -> DataFrame:
    """(signal_type, psi, drift, retrain), as quality.drift_report: daily means, at least `least` days, the last fifth against the rest."""
    days = sums.groupBy("signal_type", "date").agg(rounded(F.sum("total").cast("double") / F.sum("n"), 6).alias("value"))
    w = Window.partitionBy("signal_type")
    placed = days.withColumns({"_k": F.row_number().over(w.orderBy("date")), "_n": F.count("*").over(w)}).where(F.col("_n") >= least)
    late = F.col("_k") > F.floor(F.col("_n") * (1 - recent))
    counts = placed.groupBy("signal_type", "value").agg(F.count(F.when(~late, 1)).alias("base"), F.count(F.when(late, 1)).alias("recent"))
    return counted_psi(counts, ["signal_type"]).select("signal_type", rounded("psi", 4).alias("psi"), drift_band("psi").alias("drift"), (F.col("psi") >= 0.25).alias("retrain"))


def district_drift_from_counts(counts: DataFrame, recent: float = 0.25, least: int = 20) -> DataFrame:
    """(district_id, drift_score): mean PSI over series of at least `least` values, those of the last days against the rest. The cut lies at the
    first day that begins past 1 - recent of the series' values, so that a day is never divided and parts that add up give one result."""
    days = counts.groupBy(*SERIES, "date").agg(F.sum("n").alias("_day"))
    own = Window.partitionBy(*SERIES)
    upto = days.withColumns({"_before": F.sum("_day").over(own.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_day"), "_all": F.sum("_day").over(own)}).where(F.col("_all") >= least)
    late = upto.select(*SERIES, "date", (F.col("_before") >= F.floor(F.col("_all") * (1 - recent))).alias("_late"))
    split = counts.join(late, [*SERIES, "date"]).groupBy(*SERIES, "value").agg(F.sum(F.when(F.col("_late"), 0).otherwise(F.col("n"))).alias("base"), F.sum(F.when(F.col("_late"), F.col("n")).otherwise(0)).alias("recent"))
    found = counted_psi(split, SERIES).groupBy("district_id").agg(F.avg("psi").alias("drift_score"))
    return counts.select("district_id").distinct().join(found, "district_id", "left").select("district_id", F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"))


class DriftTables:
    """Value counts and sums of days, kept up to date by the rows of each batch; the reports don't read signals again."""

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = 20):
        self.counts = KeyedTable(spark, f"{folder}/counts", COUNTS, [*SERIES, "date", "value"], ["date"])
        self.sums = KeyedTable(spark, f"{folder}/sums", SUMS, ["signal_type", "date"])
        self.compact_after = compact_after

    def add(self, signals: DataFrame, writer: str, batch: int) -> None:
        """Adds the rows (district_id, signal_type, date, value) of a batch, once for each writer and number. Of the tables it reads the batch's days."""
        spark = signals.sparkSession
        with scratch(spark) as keep:
            rows = keep(signals.select(*SERIES, "date", F.col("value").cast("double").alias("value")))
            days = [r.date for r in rows.select("date").distinct().collect()]
            for table, own in ((self.counts, value_counts(rows)), (self.sums, day_sums(rows))):
                if table.state().writers.get(writer, -1) >= batch:
                    continue
                numbers = [c for c in own.columns if c not in table.keys]
                stands = table.read().where(F.col("date").isin([d for d in days if d]) | (F.col("date").isNull() & F.lit(None in days)))
                summed = own.unionByName(stands).groupBy(*table.keys).agg(*[F.sum(c).alias(c) for c in numbers])
                table.merge(summed, writer, batch)
                if len(table.state().folders) > self.compact_after:
                    table.compact()

    def drift_report(self) -> DataFrame:
        return drift_from_sums(self.sums.read())

    def district_drift(self) -> DataFrame:
        return district_drift_from_counts(self.counts.read())
