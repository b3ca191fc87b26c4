"""Streaming forms over small files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from watchpost.functions.stats import rolling_robust_z
from watchpost.operators import risk as ri
from watchpost.operators.detectors import HOSPITAL, SEARCH
from watchpost.streaming import updates


def test_daily_aggregate_waits_for_the_watermark(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, 12), "click", float(d)) for d in range(1, 6)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = updates.daily_aggregate(stream).writeStream.format("memory").queryName("daily_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = {str(r.date): r.value for r in spark.table("daily_out").collect()}
    assert got["2024-01-01"] == 1.0 and "2024-01-05" not in got


SIGNALS = "region string, district_id string, date date, signal_type string, value double"


def signals(seed, days=100):
    """(region, district, date, type, value) of two regions, some days missing."""
    rng, start = random.Random(seed), datetime.date(2024, 1, 1)
    out = []
    for region, district in (("x", "a"), ("x", "b"), ("y", "c")):
        for kind in (*SEARCH[:2], *HOSPITAL[:2], "social_mentions"):
            out += [(region, district, start + datetime.timedelta(d), kind, round(20 + 5 * rng.random() + (d > 85) * 4 * (d - 85), 3)) for d in range(days) if rng.random() > 0.05]
    return out


def assessed(df):
    """Scores that depend on the whole history of a district."""
    agg = df.select("district_id", "date", "signal_type", "value")
    return ri.assess_risk(agg).join(df.select("region", "district_id").distinct(), "district_id").select("region", "district_id", "date", "risk_score", "level")


def trailing(df):
    """Scores that depend on 82 rows before each day."""
    z = rolling_robust_z(df, keys=("region", "district_id", "signal_type"))
    return z.groupBy("region", "district_id", "date").agg(F.round(F.max("z"), 6).alias("z"), F.count("*").alias("n"))


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("score", "reach", "cut"), [(assessed, None, "days"), (trailing, 82, "days"), (trailing, 82, "any")])
def test_rescore_in_any_cut_equals_the_batch(spark, tmp_path, score, reach, cut):
    rows = signals(3, 95)
    want = found(score(spark.createDataFrame(rows, SIGNALS)))
    rng = random.Random(5)
    rows.sort(key=lambda r: r[2] if cut == "days" else rng.random())
    ends = [0, *sorted(rng.sample(range(1, len(rows)), 3)), len(rows)]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        spark.createDataFrame(rows[a:b], SIGNALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = updates.rescore(stream, score, str(tmp_path / "out"), str(tmp_path / "cp"), reach=reach, compact_after=2)
        q.awaitTermination(300)
        assert q.exception() is None
    scores = updates.Scores(spark, str(tmp_path / "out"), score, stream.schema, reach=reach)
    assert found(scores.read()) == want and found(scores.read("y")) == [r for r in want if r[0] == "y"]


def test_batches_that_come_again_or_correct_values(spark, tmp_path):
    rows = signals(4, 60)
    one, two = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    scores = updates.Scores(spark, str(tmp_path), trailing, spark.createDataFrame([], SIGNALS).schema, reach=82)
    df = lambda own: spark.createDataFrame(own, SIGNALS)
    scores.take(df(one), 0)
    scores.signals.merge(df(two), scores.WRITER, 1)  # the driver fails before the scores follow
    scores.take(df(two), 1)
    scores.take(df(one), 0)
    scores.take(df([]), 2)
    assert found(scores.read()) == found(trailing(df(rows)))
    before = scores.scores.state()
    scores.take(df(two[:3]), 3)  # nothing new
    (folder,) = scores.scores.state().folders.keys() - before.folders.keys()
    assert scores.scores._read(type(before)({folder: 1}, {}, 1, 0)).count() == 0
    fixed = [(*r[:4], r[4] + 100) if r[2].day == 5 else r for r in rows]
    scores.take(df([r for r in fixed if r[2].day == 5] + [(*r[:4], -1.0) for r in rows if r[2].day == 5]), 4)
    assert found(scores.read()) == found(trailing(df(fixed)))


def test_alerts_only_on_a_rise(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", datetime.date(2024, 1, d), level) for d, level in enumerate(("Normal", "Watch", "Watch", "Alert", "Normal", "Watch"), 1)]
    schema = "district_id string, date date, level string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = updates.rising_alerts(stream).writeStream.format("memory").queryName("rising_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert [(r.before, r.level) for r in spark.table("rising_out").orderBy("date").collect()] == [("Normal", "Watch"), ("Watch", "Alert"), ("Normal", "Watch")]


def test_rises_of_a_table(spark):
    rng = random.Random(1)
    levels = ("Normal", "Watch", "Warning", "Alert", "Emergency", "odd")
    rows = [(d, datetime.date(2024, 1, 1) + datetime.timedelta(k), rng.choice(levels)) for d in ("a", "b", None) for k in range(40)]
    want = []
    for d in ("a", "b", None):
        seen = 0
        for _, day, level in [r for r in rows if r[0] == d]:
            now = max(0, levels.index(level)) % 5
            if now > seen:
                want.append((d, day, levels[seen], level))
            seen = now
    assert found(updates.rising_levels(spark.createDataFrame(rows, "district_id string, date date, level string"))) == sorted(want, key=str)
