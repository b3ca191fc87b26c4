"""Tables of rows by key that are changed by merges: new rows replace those of equal keys, readers see whole states.

Every merge writes its rows into a folder of its own and then commits it; rows of later commits win. A snapshot gathers what stands.
A reader resolves the commits once and reads folders that never change afterwards, so a merge meanwhile shows as a whole
or not at all. A merge may name its writer and a number, as streaming batches have one: it is left out if that writer has
committed this number or a later one, which makes replays harmless.

Defined cases: null keys are keys like any other; rows of one merge that share a key leave one, the largest in the order of their other columns; an
empty merge commits its number alone; a table without commits is empty.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from watchpost.sources.commits import Commits

_PART = "part_folder"


@dataclass
class State:
    """Folders in force with their commit numbers, the last number of each writer, and the commit up to which a snapshot reaches."""

    folders: dict[str, int]
    writers: dict[str, int]
    version: int
    until: int


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], partition: list[str] = ()):
        """`partition`: keys by which folders are divided, so that a filter on them reads its part only."""
        self.spark, self.folder, self.keys, self.partition = spark, folder.rstrip("/"), list(keys), list(partition)
        self.schema = StructType.fromDDL(schema)
        self.commits = Commits(spark, folder)

    def state(self) -> State:
        folders, writers, version, until = {}, {}, 0, 0
        for number, commit in self.commits.newest():
            version = version or number
            if number <= until:
                break
            for writer, batch in commit.get("writers", {}).items():
                writers[writer] = max(batch, writers.get(writer, batch))
            if "until" in commit:
                if commit["until"] > until:
                    until = commit["until"]
                    folders = {f: n for f, n in folders.items() if n > until or f == commit["folder"]}
                    folders[commit["folder"]] = until
            elif commit.get("folder"):
                folders[commit["folder"]] = number
        return State(folders, writers, version, until)

    def _read(self, state: State) -> DataFrame:
        if not state.folders:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.folder}/data"
        rows = self.spark.read.option("basePath", data).schema(StructType([*self.schema.fields, StructField(_PART, StringType())])).parquet(*[f"{data}/{_PART}={f}" for f in state.folders])
        if len(state.folders) == 1:
            return rows.select(*self.schema.names)
        places = F.create_map(*[F.lit(x) for pair in state.folders.items() for x in pair])
        last = Window.partitionBy(*self.keys).orderBy(F.desc("_place"))
        # A key stands once in every folder, so the last folder's row is the row.
        return rows.withColumn("_place", places[F.col(_PART)]).withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*self.schema.names)

    def read(self) -> DataFrame:
        """The table as it stands now; later merges don't change what this frame reads."""
        return self._read(self.state())

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        writer = rows.select(*self.schema.names).write
        (writer.partitionBy(*self.partition) if self.partition else writer).parquet(f"{self.folder}/data/{_PART}={name}")
        return name

    def merge(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> int | None:
        """Puts the rows in place of those with equal keys; the commit's number, or None where this writer's batch stands already."""
        if writer is not None and self.state().writers.get(writer, -1) >= batch:
            return None
        rest = [c for c in self.schema.names if c not in self.keys]
        first = Window.partitionBy(*self.keys).orderBy(*[F.desc_nulls_last(c) for c in rest]) if rest else None
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        own = own.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k") if rest else own.distinct()
        folder = self._write(own)
        commit = {"folder": folder} | ({"writers": {writer: batch}} if writer is not None else {})

        def make(_: int) -> dict | None:
            return None if writer is not None and self.state().writers.get(writer, -1) >= batch else commit

        done = self.commits.add(make)
        return done and done[0]

    def compact(self) -> int:
        """Writes what stands as one snapshot. Merges that commit meanwhile stay in force after it."""
        state = self.state()
        folder = self._write(self._read(state))
        return self.commits.add(lambda _: {"folder": folder, "until": state.version, "writers": state.writers})[0]

    def clear(self) -> list[str]:
        """Removes folders that no state from the last snapshot on needs; readers of older states, and merges under way, must be done."""
        state, path, files = self.state(), self.commits.path, self.commits.files
        data = path(f"{self.folder}/data")
        gone = [x.getPath() for x in files.listStatus(data) if x.getPath().getName().removeprefix(f"{_PART}=") not in state.folders] if files.exists(data) else []
        for folder in gone:
            files.delete(folder, True)
        return [folder.getName().removeprefix(f"{_PART}=") for folder in gone]
