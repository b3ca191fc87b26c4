"""Bulk ingest: FHIR bundles, weather observations, sparse series, regional series and unions of sources."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from watchpost.operators.detectors import HOSPITAL
from watchpost.sources.shared import written

BUNDLE = "resourceType string, entry array<struct<resource: struct<resourceType: string, code: struct<coding: array<struct<code: string>>>, subject: struct<reference: string>, effectiveDateTime: string, valueQuantity: struct<value: double>>>>"
OBSERVATION = "main struct<temp: double, humidity: double>, rain struct<`1h`: double>"
SIGNALS = "district_id string, date date, signal_type string, value double, source_id string"


def parse_bundles(bundles: DataFrame, column: str = "bundle", source_id: str = "fhir") -> DataFrame:
    """Signals of hospital observations: first coding only, district after the last slash of the subject, day from the first
    ten characters; rows without district, day or value go."""
    entries = bundles.select(F.explode(F.from_json(column, BUNDLE)["entry"]).alias("e")).select("e.resource.*").where("resourceType = 'Observation'")
    parts = F.split(F.col("subject.reference"), "/")
    rows = entries.select(F.element_at(parts, -1).alias("district_id"), F.to_date(F.substring("effectiveDateTime", 1, 10)).alias("date"), F.get(F.col("code.coding"), F.lit(0))["code"].alias("signal_type"), F.col("valueQuantity.value").alias("value"), F.lit(source_id).alias("source_id"))
    return rows.where(F.col("signal_type").isin(*HOSPITAL) & (F.col("district_id") != "") & F.col("date").isNotNull() & F.col("value").isNotNull())


def unpivot_weather(observed: DataFrame, start, end, anchor_days: int = 3, source_id: str = "weather") -> DataFrame:
    """Three signals of each observation (district_id, date, payload JSON) on its last `anchor_days` days inside [start, end];
    rain is the hourly amount times 24, 0 where absent; missing temperature or humidity give no row."""
    parsed = observed.withColumn("o", F.from_json("payload", OBSERVATION))
    signals = F.array(
        F.struct(F.lit("weather_temp").alias("signal_type"), F.col("o.main.temp").alias("value")),
        F.struct(F.lit("weather_humidity").alias("signal_type"), F.col("o.main.humidity").alias("value")),
        F.struct(F.lit("weather_rainfall").alias("signal_type"), (F.coalesce("o.rain.1h", F.lit(0.0)) * 24).alias("value")),
    )
    days = parsed.select("district_id", F.explode(F.sequence(F.date_sub("date", anchor_days - 1), F.col("date"))).alias("date"), signals.alias("s")).where(F.col("date").between(start, end))
    return days.select("district_id", "date", F.explode("s").alias("x")).where("x.value is not null").select("district_id", "date", "x.signal_type", F.round("x.value", 3).alias("value"), F.lit(source_id).alias("source_id"))


def fill_daily(sparse: DataFrame, keys: tuple[str, ...] = ("district_id", "signal_type")) -> DataFrame:
    """Every day from the first to the last of the input, each with the last value so far; days before take the first value."""
    span = sparse.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    series = sparse.select(*keys).distinct().crossJoin(F.broadcast(span))
    grid = series.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    w = Window.partitionBy(*keys).orderBy("date")
    joined = grid.join(sparse.select(*keys, "date", "value"), [*keys, "date"], "left")
    first = F.first("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return joined.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first))


def broadcast_regional(series: DataFrame, districts: DataFrame) -> DataFrame:
    """A region's series for each of its districts; series without any value are left out."""
    usable = series.groupBy("region", "signal_type").agg(F.count("value").alias("n")).where("n > 0").select("region", "signal_type")
    return series.join(usable, ["region", "signal_type"], "left_semi").join(districts.select("region", "district_id"), "region").select("district_id", "date", "signal_type", "value")


def read_sources(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The frames of the sources that can be opened, and the status of each: `ok`, or `error:` with the reason, whatever was raised. Nothing is
    read yet: a source may still fail while it runs, see acquire."""
    frames, status = {}, {}
    for name, read in readers.items():
        try:
            frames[name] = read()
            status[name] = "ok"
        except Exception as e:  # any reader, any reason: the others go on
            status[name] = _reason(e)
    return frames, status


def _reason(e: Exception) -> str:
    """`error:` and Spark's condition or the first line of the message, with the exception's name."""
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    first = next((x.strip() for x in str(e).splitlines() if x.strip()), "")
    return f"error:{condition}" if condition else f"error:{type(e).__name__}: {first[:200]}"


def acquire(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], at_once: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads every source as jobs of its own, some at a time, and goes on whatever fails: (signals, bad, summary).

    A reader returns rows with the columns of SIGNALS, of any types that these can be read from; source_id may be missing and is the source's
    name then. signals has the sound rows of all sources that were read to their end. Rows without a district, day, type or number, after reading, are bad and stand apart as
    (source, record JSON); missing values (null) are sound. summary: (source, status, n_rows, n_bad); a source that raises, when it is opened or while it is read,
    has the status `error:...` and no rows at all, neither sound nor bad, whatever part of it had come before."""
    fields = StructType.fromDDL(SIGNALS).fields

    def one(name: str, read: Callable[[], DataFrame]) -> tuple[str, str, DataFrame | None]:
        try:
            df = read()
            missing = [f.name for f in fields if f.name not in df.columns and f.name != "source_id"]
            if missing:
                return name, f"error:no column {', '.join(missing)}", None
            read_as = {f.name: F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(name) for f in fields}
            lost = [read_as[c].isNull() for c in ("district_id", "date", "signal_type")] + [read_as["value"].isNull() & F.col("value").isNotNull()]
            record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
            told = df.select(F.lit(name).alias("source"), *[x.alias(c) for c, x in read_as.items()], F.when(reduce(or_, lost), record).alias("record"))
            return name, "ok", written(told)
        except Exception as e:  # any source, any reason: the others go on
            return name, _reason(e), None

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(lambda x: one(*x)), readers.items()))
    empty = spark.createDataFrame([], f"source string, {SIGNALS}, record string")
    every = reduce(DataFrame.unionByName, [df for _, _, df in done if df is not None], empty)
    counts = every.groupBy("source").agg(F.count(F.when(F.col("record").isNull(), 1)).alias("n"), F.count("record").alias("b"))
    listed = spark.createDataFrame([(name, status) for name, status, _ in done], "source string, status string")
    summary = listed.join(counts, "source", "left").select("source", "status", F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("b", F.lit(0)).alias("n_bad"))
    return every.where("record is null").drop("source", "record"), every.where("record is not null").select("source", "record"), summary


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows with the name of their source."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in sources.items()])


def source_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """(source, status, n_rows): a source without rows counts as failed."""
    listed = rows.sparkSession.createDataFrame([(n,) for n in names], "source string")
    found = rows.groupBy("source").agg(F.count("*").alias("n"))
    return listed.join(found, "source", "left").select("source", F.when(F.coalesce("n", F.lit(0)) > 0, "ok").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("n_rows"))
