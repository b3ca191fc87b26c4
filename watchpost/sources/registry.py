"""Model registry and artifact catalog over commit files: versions are given once, histories are in the order of their numbers."""

from __future__ import annotations

import datetime
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpost.sources.commits import Commits
from watchpost.sources.keyed import KeyedTable

ENTRY = "name string, version string, number long, created_at timestamp, framework string, metrics map<string, double>, params map<string, string>, artifact string"
CATALOG = "region string, artifact string, rows long, updated_at timestamp"


def _folder(root: str, name: str) -> str:
    # A model's name is any text: letters of a path and a leading dot or underscore, which Spark passes over, are written as codes.
    return f"{root.rstrip('/')}/model={quote(name, safe='').replace('.', '%2E').replace('_', '%5F')}"


def register_model(spark: SparkSession, root: str, name: str, metrics: dict[str, float] | None = None, params: dict[str, str] | None = None, artifact: str | None = None, framework: str = "custom", created_at: datetime.datetime | None = None) -> dict:
    """Gives the model its next version, v1 first, whatever other writers do meanwhile. The artifact, a file or folder, is copied into the
    registry before; one that doesn't exist is left out."""
    commits, kept = Commits(spark, _folder(root, name)), None
    if artifact is not None:
        path = commits.path
        source = path(artifact)
        files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(source):
            kept = f"{_folder(root, name)}/files/{uuid.uuid4().hex}/{source.getName()}"
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, commits.files, path(kept), False, spark.sparkContext._jsc.hadoopConfiguration())
    now = (created_at or datetime.datetime.now(datetime.UTC)).isoformat(timespec="seconds")
    numbers = {k: float(v) for k, v in (metrics or {}).items()}
    entry = {"name": name, "created_at": now, "framework": framework, "metrics": numbers, "params": {k: str(v) for k, v in (params or {}).items()}, "artifact": kept}
    return commits.add(lambda number: entry | {"version": f"v{number}", "number": number})[1]


def history(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Every version of the model, or of all models, with columns as in ENTRY; `number` is the order of versions (v2 before v10)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = _folder(root, name) if name is not None else f"{root.rstrip('/')}/model=*"
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits"))
    if not found:
        return spark.createDataFrame([], ENTRY)
    # Named one by one: Spark passes over folders that begin with an underscore unless it is sent there.
    return spark.read.schema(ENTRY).json([x.getPath().toString() for x in found])


def latest_models(entries: DataFrame) -> DataFrame:
    """The last version of each model in a history, with total_versions."""
    own = Window.partitionBy("name")
    last = entries.withColumns({"_k": F.row_number().over(own.orderBy(F.desc("number"))), "total_versions": F.count("*").over(own)})
    return last.where("_k = 1").drop("_k")


class Catalog:
    """(region, artifact, rows, updated_at) of the artifacts written, one row each; readers see whole states."""

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = 20):
        self.table, self.compact_after = KeyedTable(spark, folder, CATALOG, ["region", "artifact"]), compact_after

    def record(self, rows: DataFrame) -> None:
        """Takes over (region, artifact, rows), with updated_at or the time of now."""
        self.table.merge(rows if "updated_at" in rows.columns else rows.withColumn("updated_at", F.current_timestamp()))
        state = self.table.state()
        if len(state.folders) > self.compact_after:
            self.table.compact()

    def read(self, region: str | None = None) -> DataFrame:
        df = self.table.read()
        return df if region is None else df.where(F.col("region") == region)
