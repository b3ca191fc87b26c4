"""Commits, keyed tables, the model registry and the catalog under writers at the same time."""

import datetime
import os
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from watchpost.sources import registry
from watchpost.sources.commits import Commits
from watchpost.sources.keyed import KeyedTable

SCHEMA = "region string, k long, v string"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def state(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_numbers_are_given_once(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"))
    with ThreadPoolExecutor(20) as pool:
        done = list(pool.map(lambda i: Commits(spark, str(tmp_path / "c")).add(lambda n: {"writer": i, "n": n}), range(40)))
    assert sorted(n for n, _ in done) == list(range(1, 41)) == commits.numbers()
    assert all(commits.read(n) == c == {"writer": c["writer"], "n": n} for n, c in done)
    assert {c["writer"] for _, c in done} == set(range(40)) and not [f for f in os.listdir(commits.local) if f.endswith(".tmp")]
    assert commits.add(lambda n: None) is None and next(commits.newest())[0] == 40


def test_commits_by_rename(spark, tmp_path):
    """As in a file system that isn't local."""
    one, two = (Commits(spark, f"file://{tmp_path}/c") for _ in range(2))
    assert one.local == f"{tmp_path}/c/_commits"
    one.local = two.local = None
    assert one.add(lambda n: {"a": n}) == (1, {"a": 1}) and two.add(lambda n: {"b": "ü"}) == (2, {"b": "ü"})
    assert not one._place(2, b"{}") and two.read(2) == {"b": "ü"} and one.numbers() == [1, 2]


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(1), {}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["region", "k"], ["region"])
    assert state(table) == []
    for step in range(8):
        own = [(rng.choice(["x", "y", None]), rng.choice([None, *range(6)]), f"{step}-{i}") for i in range(rng.randrange(7))]
        table.merge(rows(spark, *own).repartition(3))
        for r in sorted(own, key=lambda r: r[2]):
            want[r[:2]] = r
        if step in (3, 6):
            table.compact()
        assert state(table) == sorted(want.values(), key=str)
    assert table.clear() and state(table) == sorted(want.values(), key=str)
    assert table.read().where("region = 'x'").count() == sum(k[0] == "x" for k in want)


def test_replayed_batches_change_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["region", "k"])
    assert table.merge(rows(spark, ("x", 1, "a")), "w", 0) == 1
    assert table.merge(rows(spark, ("x", 1, "b")), "w", 0) is None
    assert table.merge(rows(spark), "w", 3) == 2 and table.merge(rows(spark, ("x", 1, "c")), "w", 2) is None
    table.compact()
    assert table.merge(rows(spark, ("x", 1, "d")), "w", 3) is None and state(table) == [("x", 1, "a")]
    assert table.merge(rows(spark, ("x", 1, "e")), "other", 0) and state(table) == [("x", 1, "e")]


def test_readers_see_whole_states(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["region", "k"])
    table.merge(rows(spark, ("x", 1, "old"), ("x", 2, "old")))
    before = table.read()
    folder = table._write(rows(spark, ("x", 1, "new"), ("x", 2, "new")))  # written, not committed yet
    assert {r.v for r in table.read().collect()} == {"old"}
    during = table.state().version
    table.commits.add(lambda n: {"folder": folder})
    assert {r.v for r in before.collect()} == {"old"} and {r.v for r in table.read().collect()} == {"new"}
    # A snapshot of a state that a merge has overtaken doesn't hide the merge.
    stale = table.state()
    table.merge(rows(spark, ("x", 3, "late")))
    table.commits.add(lambda n: {"folder": table._write(table._read(stale)), "until": stale.version, "writers": {}})
    assert state(table) == [("x", 1, "new"), ("x", 2, "new"), ("x", 3, "late")] and during < table.state().version


def test_many_writers_register_each_version_once(spark, tmp_path):
    root = str(tmp_path / "models")
    with ThreadPoolExecutor(20) as pool:
        done = list(pool.map(lambda i: registry.register_model(spark, root, "flu model/2", {"auc": i}, {"depth": i}), range(20)))
    assert sorted(int(d["version"][1:]) for d in done) == list(range(1, 21))
    entries = registry.history(spark, root, "flu model/2").orderBy("number").collect()
    assert [r.version for r in entries] == [f"v{n}" for n in range(1, 21)] and {r.metrics["auc"] for r in entries} == set(map(float, range(20)))
    (tmp_path / "weights.bin").write_bytes(b"w")
    other = registry.register_model(spark, root, "_odd.name", artifact=str(tmp_path / "weights.bin"), framework="numpy", created_at=datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC))
    assert open(other["artifact"].removeprefix("file:"), "rb").read() == b"w"
    assert registry.register_model(spark, root, "_odd.name", artifact=str(tmp_path / "none"))["artifact"] is None
    last = {r.name: (r.version, r.total_versions) for r in registry.latest_models(registry.history(spark, root)).collect()}
    assert last == {"flu model/2": ("v20", 20), "_odd.name": ("v2", 2)}
    assert registry.history(spark, root, "none").count() == 0 and registry.history(spark, str(tmp_path / "nowhere")).count() == 0


def test_catalog_keeps_one_row_an_artifact(spark, tmp_path):
    catalog = registry.Catalog(spark, str(tmp_path / "catalog"), compact_after=3)
    for k in range(9):
        catalog.record(spark.createDataFrame([("r", "signals", k), (f"r{k % 2}", "risk", 10 * k)], "region string, artifact string, rows long"))
    got = {(r.region, r.artifact): r.rows for r in catalog.read().collect()}
    assert got == {("r", "signals"): 8, ("r0", "risk"): 80, ("r1", "risk"): 70}
    assert len(catalog.table.state().folders) <= 4 and catalog.read("r0").select(F.max("rows")).first()[0] == 80
