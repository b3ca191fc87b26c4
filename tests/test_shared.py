"""Tables in shared storage."""

import os

import pytest

from watchpost.sources import shared


def test_written_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, None)], "k long, s string, xs array<int>")
    again = shared.written(df)
    assert again.schema == df.schema and sorted(again.collect(), key=str) == sorted(df.collect(), key=str)
    assert shared.written(df.limit(0)).count() == 0


def test_scratch_tables_leave_with_their_block(spark):
    with shared.scratch(spark) as keep:
        table = keep(spark.range(5))
        (path,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        total = shared.written(table.groupBy().sum("id"))
    assert total.first()[0] == 10 and not os.path.exists(path.removeprefix("file://"))


def test_folders_are_new_and_a_cluster_needs_shared_storage(spark, monkeypatch):
    assert shared.shared_dir(spark) != shared.shared_dir(spark)

    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)
