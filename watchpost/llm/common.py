"""What the document operators share: reading a table, Arrow slices, what a worker keeps, and row keys."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpost.sources.shared import shared_dir, written

__all__ = ["as_bytes", "fresh", "hash_sample", "held_out", "kept", "lower_ascii", "shared_dir", "slices", "table", "written"]

#: The white space that separates words, code points 32 and 9 to 13, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of a batch, and bytes of its texts, that are turned into Python objects at once; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and bytes, which bounds the Python objects alive at once."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


_kept: dict[tuple, Any] = {}


def kept(name: tuple, make: Callable[[], Any]) -> Any:
    """What this worker process made under that name. A worker keeps one such thing: those of other operators and stages leave, so
    that a pipeline's memory is that of its largest stage."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        if sys.platform == "linux":  # freed memory goes back to the machine, not only to this process
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)
        _kept[name] = make()
    return _kept[name]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, with underscores before those that columns of df have already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 2


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_sample(df: DataFrame, key: str, drawn: Column, rows: int) -> DataFrame:
    """At most `rows` rows of each key, those of the least hashes, with their rank as `_r`. Rows that can't be among them leave
    before any shuffle of rows by key; the others are ranked within their partition first, so that no task gets a whole hot key."""
    placed = df.withColumn("_place", F.pmod(drawn, F.lit(1 << 40)))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    near = placed.join(sizes, key).where(F.col("_place") < F.lit(float(1 << 40)) * F.least(F.lit(1.0), (2 * rows + 100) / F.col("_size")))
    rest = ["_place", *[c for c in df.columns if c != key]]
    ranked = near.withColumn("_part", F.spark_partition_id()).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*rest)))
    return ranked.where(F.col("_r") <= rows).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*rest))).where(F.col("_r") <= rows).drop("_place", "_size", "_part")
