"""Replacement in one step: snapshots behind a manifest, and a database in one transaction."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from originline.sources import jdbc as J
from originline.sources import tables as T
from originline.sources.snapshots import Conflict, SnapshotTable
from tests.helpers import FOUR, bookings

PREDICTIONS = T.declared("predictions")[0].fieldNames()


def split_rows(spark, ids, split="train"):
    return spark.createDataFrame([(i, split) for i in ids], "sample_id string, split string")


def ids(frame):
    return sorted(r["sample_id"] for r in frame.collect())


def predictions(spark, *rows):
    return spark.createDataFrame([(*r, "Gym", 1, 1, 1.0, "Gym") for r in rows], PREDICTIONS)


def failing(rows):
    """Rows of which the later ones cannot be computed."""
    bad = F.when(F.col("sample_id") == "s9", F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("split"))
    return rows.withColumn("split", bad)


def test_a_failed_write_leaves_the_old_rows(spark):
    path = T.scratch(spark, "splits")
    assert T.overwrite_table(split_rows(spark, ["s1", "s2"]), "splits", path) == 2
    with pytest.raises(Exception, match="broken row"):
        T.overwrite_table(failing(split_rows(spark, [f"s{i}" for i in range(20)]).repartition(4)), "splits", path)
    assert ids(T.read_table(spark, "splits", path)) == ["s1", "s2"]
    table = T.snapshots(spark, "splits", path)
    assert table.versions() == [1]
    assert T.overwrite_table(split_rows(spark, ["s3"]), "splits", path) == 1
    assert ids(T.read_table(spark, "splits", path)) == ["s3"]
    assert len(table.vacuum()) == 2 and ids(table.read()) == ["s3"]  # the old rows and what the failed write left


def test_a_failed_publish_leaves_the_old_rows_and_can_be_repeated(spark, monkeypatch):
    path = T.scratch(spark, "splits")
    table = T.snapshots(spark, "splits", path)
    table.replace(split_rows(spark, ["s1"]))
    right = table.files.publish

    def broken(name, text):
        raise OSError("the store is away")

    monkeypatch.setattr(table.files, "publish", broken)
    with pytest.raises(OSError):
        table.replace(split_rows(spark, ["s2"]))
    assert ids(T.read_table(spark, "splits", path)) == ["s1"]
    monkeypatch.setattr(table.files, "publish", right)
    table.replace(split_rows(spark, ["s2"]))
    assert ids(T.read_table(spark, "splits", path)) == ["s2"]


def test_reading_and_replacing_in_one_job(spark):
    path = T.scratch(spark, "splits")
    T.overwrite_table(split_rows(spark, ["s1", "s2", "s3"]), "splits", path)
    before = T.read_table(spark, "splits", path)
    assert T.overwrite_table(before.filter("sample_id <> 's2'"), "splits", path) == 2
    assert ids(T.read_table(spark, "splits", path)) == ["s1", "s3"]
    assert ids(before) == ["s1", "s2", "s3"]  # a reader keeps the version it opened
    assert ids(T.snapshots(spark, "splits", path).read(version=1)) == ["s1", "s2", "s3"]


def test_two_writers_of_one_version(spark):
    path = T.scratch(spark, "splits")
    first, second = T.snapshots(spark, "splits", path), T.snapshots(spark, "splits", path)
    late = second.manifest()
    first.replace(split_rows(spark, ["s1"]))
    second.manifest = lambda version=None: late
    with pytest.raises(Conflict):
        second.replace(split_rows(spark, ["s2"]))
    assert ids(T.read_table(spark, "splits", path)) == ["s1"]


def test_one_partition_is_replaced(spark):
    path = T.scratch(spark, "predictions")
    T.overwrite_table(predictions(spark, ("t1", "m1", "s1"), ("t1", "m2", "s1"), (None, "m1", "s1")), "predictions", path)
    T.overwrite_predictions(predictions(spark, ("t1", "m1", "s2"), ("t1", "m1", "s3")), "t1", "m1", path)
    found = {(r["track"], r["model"], r["sample_id"]) for r in T.read_table(spark, "predictions", path).collect()}
    assert found == {("t1", "m1", "s2"), ("t1", "m1", "s3"), ("t1", "m2", "s1"), (None, "m1", "s1")}
    table = T.snapshots(spark, "predictions", path)
    assert ids(table.read(track="t1", model="m1")) == ["s2", "s3"] and table.manifest().rows == 4
    assert len(table.read(track="t1", model="m1").inputFiles()) < len(table.read().inputFiles())
    with pytest.raises(ValueError, match="another track or model"):
        T.overwrite_predictions(predictions(spark, ("t1", "m1", "s2")), "t1", "m2", path)
    with pytest.raises(ValueError, match="partition"):
        table.replace_partition(predictions(spark, ("t1", "m1", "s2")), track="t1")
    T.overwrite_predictions(predictions(spark, ("t1", "m2", "x")).limit(0), "t1", "m2", path)
    assert ("t1", "m2", "s1") not in {tuple(r)[:3] for r in T.read_table(spark, "predictions", path).collect()}


def test_empty_tables_and_unknown_versions(spark):
    path = T.scratch(spark, "splits")
    assert not SnapshotTable.is_one(spark, path)
    table = T.snapshots(spark, "splits", path)
    assert table.read().count() == 0 and table.versions() == []
    assert T.overwrite_table(split_rows(spark, ["s1"]).limit(0), "splits", path) == 0
    assert T.read_table(spark, "splits", path).count() == 0
    with pytest.raises(ValueError, match="no version"):
        table.read(version=7)
    with pytest.raises(ValueError, match="not partitioned"):
        table.read(track="t1")
    with pytest.raises(ValueError, match="no column"):
        T.overwrite_table(split_rows(spark, ["s1"]).withColumn("zz", F.lit(1)), "splits", path)


# ------------------------------------------------------------------- database


@pytest.fixture
def derby():
    return {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def many_bookings(spark, n=500):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"B{i * 7919 % n:05d}'", f"R{i % 9}", "Gym", str(start + datetime.timedelta(minutes=i)), str(start + datetime.timedelta(hours=i + 5))) for i in range(n)]
    return bookings(spark, rows).repartition(3)


def test_database_read_by_ranges_equals_parquet(spark, derby):
    path, table = T.scratch(spark, "bookings"), {**derby, "dbtable": "bookings"}
    T.overwrite_table(many_bookings(spark), "bookings", path)
    assert T.overwrite_table(T.read_table(spark, "bookings", path, ordered=False), "bookings", jdbc=table) == 500
    got = T.read_table(spark, "bookings", jdbc=table, ordered=False, partitions=6)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert len(sizes) == 6 and min(sizes) >= 80 and sum(sizes) == 500
    assert T.read_table(spark, "bookings", jdbc=table).collect() == T.read_table(spark, "bookings", path).collect()


def test_ranges_cover_every_key_once(spark, derby):
    rows = [(None, 1), (5, 2), (5, 3), (5, 4), (7, 5), (-2, 6)]
    J.replace(spark.createDataFrame(rows, "k int, v int"), derby, "t")
    got = J.read(spark, derby, "t", '"k"', 4)
    assert sorted(r["v"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    J.replace(spark.createDataFrame([], "k int, v int"), derby, "t")
    assert J.read(spark, derby, "t", '"k"', 4).count() == 0
    assert J.ranges("k", ["a'b", "c"]) == ["k < 'a''b' OR k IS NULL", "k >= 'a''b' AND k < 'c'", "k >= 'c'"]


def test_a_failed_database_write_leaves_the_old_rows(spark, derby):
    table = {**derby, "dbtable": "splits"}
    T.overwrite_table(split_rows(spark, ["s1", "s2"]), "splits", jdbc=table)
    with pytest.raises(Exception, match="broken row"):
        T.overwrite_table(failing(split_rows(spark, [f"s{i}" for i in range(20)]).repartition(4)), "splits", jdbc=table)
    assert ids(T.read_table(spark, "splits", jdbc=table)) == ["s1", "s2"]
    with J._Transaction(spark, derby) as t:  # nothing is left beside the table
        found, names = t.connection.getMetaData().getTables(None, None, "%SPLITS%", None), []
        while found.next():
            names.append(found.getString("TABLE_NAME"))
    assert names == ["SPLITS"]


def test_one_partition_of_a_database_table(spark, derby):
    table = {**derby, "dbtable": "predictions"}
    T.overwrite_table(predictions(spark, ("t1", "m1", "s1"), ("t1", "m2", "s1")), "predictions", jdbc=table)
    T.overwrite_predictions(predictions(spark, ("t1", "m1", "s2")), "t1", "m1", jdbc=table)
    found = {(r["model"], r["sample_id"]) for r in T.read_table(spark, "predictions", jdbc=table).collect()}
    assert found == {("m1", "s2"), ("m2", "s1")}
    with pytest.raises(ValueError, match="another track or model"):
        T.overwrite_predictions(predictions(spark, ("t1", "m1", "s2")), "t1", "m2", jdbc=table)


def test_bookings_fixture_round_trip(spark, derby):
    df, table = bookings(spark, FOUR), {**derby, "dbtable": "bookings"}
    T.overwrite_table(df, "bookings", jdbc=table)
    assert T.read_table(spark, "bookings", jdbc=table, partitions=2).collect() == df.orderBy("booking_id").collect()
