"""Models trained on Spark: novelty by principal components, isolation forests by district, averaged logistic regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.functions.scoring import clamp, rounded
from watchpost.operators.detectors import HOSPITAL, SEARCH
from watchpost.operators.knowledge import DISEASES
from watchpost.sources.shared import written

#: Groups whose weights are broadcast.
FEW_GROUPS = 100_000
NOVELTY_SIGNALS = (*HOSPITAL, *SEARCH, "social_mentions", "wastewater_viral_load")


def _uniform(*parts):
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003.0


def novelty_training(spark, samples: int = 60) -> DataFrame:
    """Partial presentations of each disease over the diagnostic signals, drawn from hashes."""
    profile = {d[0]: d[5] for d in DISEASES}
    rows = spark.createDataFrame([(k,) for k in profile], "disease string").crossJoin(spark.range(samples).withColumnRenamed("id", "sample"))
    columns = []
    for s in NOVELTY_SIGNALS:
        has = F.col("disease").isin(*[k for k, v in profile.items() if s in v])
        kept = _uniform("disease", "sample", F.lit(s + "keep")) > 0.3
        columns.append(F.when(has & kept, 0.4 + 0.6 * _uniform("disease", "sample", F.lit(s + "high"))).otherwise(0.12 * _uniform("disease", "sample", F.lit(s + "low"))).alias(s))
    return rows.select(*columns)


def novelty_score(driver_rows: DataFrame, components: int = 4) -> DataFrame:
    """(district_id, date, novelty): reconstruction error of a cell's drivers beyond that of known presentations, as column
    arithmetic with the loadings; a cell without diagnostic drivers scores 0."""
    training = novelty_training(driver_rows.sparkSession)
    stats = training.agg(*[f(s).alias(f"{n}_{s}") for s in NOVELTY_SIGNALS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = lambda s: (F.col(s) - stats[f"m_{s}"]) / (stats[f"s_{s}"] + 1e-6)
    standard = training.select(*[scaled(s).alias(s) for s in NOVELTY_SIGNALS])
    vectors = VectorAssembler(inputCols=list(NOVELTY_SIGNALS), outputCol="x").transform(standard)
    loadings = np.array(PCA(k=components, inputCol="x", outputCol="p").fit(vectors).pc.toArray())
    residual = np.eye(len(NOVELTY_SIGNALS)) - loadings @ loadings.T

    def error():
        total = F.lit(0.0)
        for j in range(len(NOVELTY_SIGNALS)):
            part = sum((float(residual[i, j]) * scaled(s) for i, s in enumerate(NOVELTY_SIGNALS)), F.lit(0.0))
            total = total + part * part
        return F.sqrt(total)

    p50, p95 = training.select(error().alias("e")).agg(F.percentile("e", F.array(F.lit(0.5), F.lit(0.95))).alias("q")).first().q
    wide = driver_rows.groupBy("district_id", "date").pivot("signal_type", list(NOVELTY_SIGNALS)).agg(F.max("anomaly"))
    filled = wide.select("district_id", "date", *[clamp(F.coalesce(F.col(s), F.lit(0.0))).alias(s) for s in NOVELTY_SIGNALS])
    quiet = F.greatest(*NOVELTY_SIGNALS) <= 1e-6
    return filled.select("district_id", "date", F.when(quiet, 0.0).otherwise(rounded(clamp((error() - p95) / (2 * max(p95 - p50, 1e-6))), 4)).alias("novelty"))


def _path_length(x: np.ndarray, depth: int, limit: int, rng: np.random.Generator, rows: np.ndarray, out: np.ndarray, within: np.ndarray) -> None:
    """Adds each row's depth in a random tree that is grown on the sample `within`."""
    if depth >= limit or len(within) <= 1:
        m = len(within)
        out[rows] += depth + (2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2))
        return
    low, high = x[within].min(0), x[within].max(0)
    wide = np.flatnonzero(high > low)
    if not len(wide):
        out[rows] += depth
        return
    f = rng.choice(wide)
    cut = rng.uniform(low[f], high[f])
    for side in (True, False):
        _path_length(x, depth + 1, limit, rng, rows[(x[rows, f] < cut) == side], out, within[(x[within, f] < cut) == side])


def joint_context_iforest(anomalies: DataFrame, trees: int = 120, sample: int = 256) -> DataFrame:
    """(district_id, date, context): isolation-forest scores of the z-vectors of a district, scaled between the median and the
    99th percentile; districts of under 20 days have 0. Each district is a group of bounded size: its days."""
    wide = anomalies.groupBy("district_id", "date").pivot("signal_type", list(HOSPITAL)).agg(F.max("z")).fillna(0.0)

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x, context = part[list(HOSPITAL)].to_numpy(float), np.zeros(len(part))
        if len(x) >= 20:
            rng, depth = np.random.default_rng(42), np.zeros(len(x))
            for _ in range(trees):
                within = rng.choice(len(x), min(sample, len(x)), replace=False)
                _path_length(x, 0, int(np.ceil(np.log2(len(within)))), rng, np.arange(len(x)), depth, within)
            strange = -depth / trees
            low, high = np.percentile(strange, [50, 99])
            context = np.clip((strange - low) / (high - low), 0, 1) if high > low else context
        return pd.DataFrame({"district_id": part["district_id"], "date": part["date"], "context": context})

    return wide.groupBy("district_id").applyInPandas(score, "district_id string, date date, context double")


def grouped_param_average(rows: DataFrame, group: str, features: list[str], label: str, rounds: int = 20, epochs: int = 3, rate: float = 0.5) -> list[float]:
    """Rounds of local gradient steps in every group from shared weights, then the mean of the weights by group size. Groups' weights stay a
    table: a step joins it with the rows and sums gradients by group, so that no group has to fit anywhere; only the mean reaches the driver.
    Up to FEW_GROUPS groups the weights are broadcast and the rows stay where they are: a step then shuffles one sum of each group and task. With more
    groups rows and weights are joined by group. Equal rows of a group are one row with their number, which all steps go through instead. Rows with a
    missing value are left out; without rows all weights are 0."""
    whole = rows.select(F.col(group).cast("string").alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")).na.drop()
    data = written(whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("k")))
    names = [f"w{i}" for i in range(len(features) + 1)]
    mean = [0.0] * len(names)
    few = data.select("g").distinct().count() <= FEW_GROUPS
    for _ in range(rounds):
        state = None
        for _ in range(epochs):
            held = data.withColumns({w: F.lit(v) for w, v in zip(names, mean, strict=True)}) if state is None else data.join(F.broadcast(state.drop("n")) if few else state.drop("n"), "g")
            state = _stepped(held, names, rate)
        found = state.agg(*[(F.sum(F.col("n") * F.col(w)) / F.sum("n")).alias(w) for w in names]).first()
        mean = [found[w] or 0.0 for w in names]
    return mean


def _stepped(held: DataFrame, names: list[str], rate: float) -> DataFrame:
    """(g, n, weights) after one step of each group: `held` has the rows, each with its number k and its group's weights."""
    inputs = [F.col(f"x{i}") for i in range(len(names) - 1)] + [F.lit(1.0)]
    z = sum((F.col(w) * x for w, x in zip(names, inputs, strict=True)), F.lit(0.0))
    miss = held.withColumn("_miss", 1 / (1 + F.exp(-z)) - F.col("y"))
    sums = miss.groupBy("g").agg(F.sum("k").alias("n"), *[F.first(w).alias(w) for w in names], *[F.sum(F.col("k") * F.col("_miss") * x).alias(f"d{i}") for i, x in enumerate(inputs)])
    return sums.select("g", "n", *[(F.col(w) - rate * F.col(f"d{i}") / F.col("n")).alias(w) for i, w in enumerate(names)])


def pooled_logistic(rows: DataFrame, features: list[str], label: str, rounds: int = 20, epochs: int = 3, rate: float = 0.5) -> list[float]:
    """The same trainer with all rows in one group."""
    return grouped_param_average(rows.withColumn("_all", F.lit("all")), "_all", features, label, rounds, epochs, rate)


def logistic_probability(weights: list[float], features: list[str]):
    z = sum((w * F.col(f) for w, f in zip(weights, features, strict=False)), F.lit(float(weights[-1])))
    return 1 / (1 + F.exp(-z))

