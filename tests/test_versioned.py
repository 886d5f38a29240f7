"""Increments into buckets: what is rewritten, what readers see, and what a merge that breaks off leaves."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.sources.versioned import VersionedTable


def newest(rows):
    last = Window.partitionBy("k").orderBy(F.col("ordinal").desc())
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1")


def frame(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string")


def held(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["k"], 8)


def test_only_touched_buckets_are_rewritten(spark, table):
    assert table.read() is None
    assert table.merge(frame(spark, *((k, "a") for k in range(100))), newest) == 1
    before = table.manifest()
    assert len(before["buckets"]) == 8
    assert table.merge(frame(spark, (5, "b"), (1000, "new")), newest) == 2
    after = table.manifest()
    changed = {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)}
    assert 1 <= len(changed) <= 2
    wanted = {k: "a" for k in range(100)} | {5: "b", 1000: "new"}
    assert held(table.read()) == wanted and held(table.read(before)) == {k: "a" for k in range(100)}
    assert table.merge(frame(spark), newest) == 2
    assert table.vacuum() == 0 or held(table.read()) == wanted
    assert held(table.read()) == wanted


def test_a_merge_that_breaks_off_leaves_the_table_whole(spark, table, monkeypatch):
    table.merge(frame(spark, (1, "a"), (2, "a"), (None, "n")), newest)
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.merge(frame(spark, (1, "b"), (3, "b")), newest)
    assert held(table.read()) == {1: "a", 2: "a", None: "n"} and table.manifest()["version"] == 1
    assert table.merge(frame(spark, (1, "c"), (None, "m")), newest) == 2
    assert held(table.read()) == {1: "c", 2: "a", None: "m"}
    assert table.vacuum() >= 1 and held(table.read()) == {1: "c", 2: "a", None: "m"}


def test_of_two_merges_at_once_one_fails(spark, table):
    table.merge(frame(spark, (1, "a")), newest)
    late = table.manifest()
    table.merge(frame(spark, (1, "b")), newest)
    with pytest.raises(RuntimeError):
        table._commit(late | {"version": 2})
    assert held(table.read()) == {1: "b"}
    folder = table.path.removeprefix("file://") + "/manifests"
    assert sorted(n for n in os.listdir(folder) if not n.startswith(".")) == ["000000001.json", "000000002.json"]
