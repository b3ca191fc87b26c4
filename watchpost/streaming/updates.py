"""Streaming forms of the daily update: event aggregation, re-scoring of each micro-batch, alerts on rising levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from watchpost.functions.scoring import LEVELS, level_order
from watchpost.sources.keyed import KeyedTable
from watchpost.sources.shared import scratch

CELL = ["region", "district_id", "date"]
#: Regions of a micro-batch up to which they become a filter.
MANY = 500


def daily_aggregate(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(date, event_type, n, value): tumbling days over event time; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return grouped.select(F.to_date("window.start").alias("date"), "event_type", "n", "value")


def rescore(signals: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str = "signal_type", reach: int | None = None, compact_after: int = 20) -> StreamingQuery:
    """Keeps the scores of a growing table of signals up to date, micro-batch by micro-batch, as if all rows had been there at once.

    signals: (region, district_id, date, <key>, value) as a stream; a later micro-batch replaces the value of a cell, of rows that share a cell within one
    the largest counts. score: a batch operator from rows like these to rows with region, district_id and date, one each. Its scores of a district may depend on
    all of the district's rows; where they depend on no more than `reach` rows of each series before their day, only these and what follows the first
    changed day are read and scored again. See Scores for the tables in `folder`: replayed batches change nothing, and only rows that differ are written."""
    scores = Scores(signals.sparkSession, folder, score, signals.schema, key, reach, compact_after)
    return signals.writeStream.foreachBatch(scores.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Scores:
    """Signals and their scores as keyed tables in a folder; merges name the micro-batch, so that each counts once."""

    WRITER = "rescore"

    def __init__(self, spark: SparkSession, folder: str, score: Callable[[DataFrame], DataFrame], schema: StructType, key: str = "signal_type", reach: int | None = None, compact_after: int = 20):
        self.score, self.key, self.reach, self.compact_after = score, key, reach, compact_after
        cells = ["region", "district_id", "date", key]
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.signals = KeyedTable(spark, f"{folder}/signals", ", ".join(f"{c} {kinds[c]}" for c in [*cells, "value"]), cells, ["region"])
        found = score(spark.createDataFrame([], self.signals.schema)).schema
        self.columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.fields]
        self.scores = KeyedTable(spark, f"{folder}/scores", ", ".join(self.columns), CELL, ["region"])

    def take(self, batch: DataFrame, number: int) -> None:
        """Merges a batch of signals and then what it changes in the scores. After a failure between the two the batch comes again, and the
        scores follow from the signals that stand."""
        with scratch(batch.sparkSession) as keep:
            rows = keep(batch.select(*self.signals.schema.names))
            self.signals.merge(rows, self.WRITER, number)
            if self.scores.state().writers.get(self.WRITER, -1) >= number:
                return
            touched = keep(rows.groupBy("region", "district_id").agg(F.min("date").alias("_from")))
            self.scores.merge(self._changed(touched, keep), self.WRITER, number)
        for table in (self.signals, self.scores):
            if len(table.state().folders) > self.compact_after:
                table.compact()

    def _changed(self, touched: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Scores of the districts touched that differ from those that stand. Regions are few, so those at hand become a filter that reads their part only."""
        regions = [r.region for r in touched.select("region").distinct().limit(MANY + 1).collect()]
        near = lambda df: df if len(regions) > MANY or None in regions else df.where(F.col("region").isin(regions))
        within = F.col("s.region").eqNullSafe(F.col("t.region")) & F.col("s.district_id").eqNullSafe(F.col("t.district_id"))
        own = near(self.signals.read()).alias("s").join(touched.alias("t"), within).select("s.*", "t._from")
        if self.reach is not None:
            back = Window.partitionBy("region", "district_id", self.key, F.col("date") < F.col("_from")).orderBy(F.desc("date"))
            own = own.withColumn("_k", F.row_number().over(back)).where((F.col("date") >= F.col("_from")) | (F.col("_k") <= self.reach)).drop("_k")
        new = self.score(keep(own.drop("_from")))
        if self.reach is not None:
            new = new.alias("s").join(touched.alias("t"), within & (F.col("s.date") >= F.col("t._from")), "left_semi")
        new = keep(new.select(*self.scores.schema.names))
        old = near(self.scores.read())
        same = [F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in self.scores.schema.names if c not in CELL]
        met = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in CELL]
        return new.alias("n").join(old.alias("o"), reduce(and_, [*met, *same]), "left_anti")

    def read(self, region: str | None = None) -> DataFrame:
        df = self.scores.read()
        return df if region is None else df.where(F.col("region") == region)


class _Rising(StatefulProcessor):
    """Keeps the last level of a district and passes on rows whose level is above it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "level int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen = self.last.get()[0] if self.last.exists() else 0
        part = pd.concat(list(rows)).sort_values("date")
        out = []
        for row in part.itertuples(index=False):
            now = LEVELS.index(row.level) if row.level in LEVELS else 0
            if now > seen:
                out.append((key[0], row.date, LEVELS[seen], row.level))
            seen = now
        self.last.update((seen,))
        yield pd.DataFrame(out, columns=["district_id", "date", "before", "level"])

    def close(self) -> None:
        pass


def rising_alerts(risk: DataFrame) -> DataFrame:
    """(district_id, date, before, level) whenever a district's level goes up. Needs the RocksDB state store."""
    return risk.groupBy("district_id").transformWithStateInPandas(_Rising(), "district_id string, date date, before string, level string", "Append", "None")


def rising_levels(risk: DataFrame) -> DataFrame:
    """The same rows from a table at once: (district_id, date, before, level) where a district's level is above that of its row before, Normal before the first."""
    own = Window.partitionBy("district_id").orderBy("date")
    ordered = risk.withColumns({"_now": level_order("level"), "_before": F.coalesce(F.lag(level_order("level")).over(own), F.lit(0))})
    names = F.array(*[F.lit(x) for x in LEVELS])
    return ordered.where(F.col("_now") > F.col("_before")).select("district_id", "date", names[F.col("_before")].alias("before"), "level")
