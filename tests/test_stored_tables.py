"""Stored rows, databases, collections, deep pages, pieces and the streaming sink."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, scans
from shelfmark.session import finished_folders
from shelfmark.sources import databases, files
from shelfmark.sources.stored_rows import StoredRows
from shelfmark.streaming import replies, sink


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(table):
    return {r.id: r.v for r in table.read().collect()}


def changed_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_stored_rows_follow_a_dictionary(spark, tmp_path):
    """Random changes, with snapshots between, against a plain dictionary; null keys are a key."""
    rng, want = random.Random(4), {}
    table = StoredRows(spark, str(tmp_path / "t"), "id long, v string", "id", buckets=4)
    assert rows_of(table) == {} and table.compact() == []
    for step in range(8):
        if step % 4 == 3:
            gone = rng.sample([k for k in want if k is not None], 3)
            table.delete(spark.createDataFrame([(k,) for k in gone], "id long"))
            for k in gone:
                del want[k]
        else:
            rows = {rng.choice([None, *range(30)]): f"{step}-{i}" for i in range(6)}
            table.append(spark.createDataFrame(list(rows.items()), "id long, v string"))
            want |= rows
        assert rows_of(table) == want
        if step in (2, 5):
            table.compact()
            assert rows_of(table) == want == rows_of(StoredRows(spark, str(tmp_path / "t"), "id long, v string", "id", buckets=4))


def test_a_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    table = StoredRows(spark, str(tmp_path / "t"), "id long, v string", "id", buckets=16)
    table.append(spark.range(400).select("id", F.lit("a").alias("v")))
    assert len(table.compact()) == 16
    before = changed_files(tmp_path / "t")
    table.append(spark.createDataFrame([(7, "b")], "id long, v string"))
    during = table.read()  # planned before the change
    (bucket,) = table.compact()
    after = changed_files(tmp_path / "t")
    assert before.items() <= after.items()
    state = [f for f in after.keys() - before.keys() if "/state/" in f]
    assert state and all(f"__bucket={bucket}" in f for f in state)
    assert {r.id: r.v for r in during.collect()} == rows_of(table) == {i: "b" if i == 7 else "a" for i in range(400)}


def test_unfinished_changes_are_not_seen(spark, tmp_path):
    """A batch and a list whose job did not end."""
    table = StoredRows(spark, str(tmp_path / "t"), "id long, v string", "id", buckets=2)
    table.append(spark.createDataFrame([(1, "a")], "id long, v string"))
    table.compact()
    table.append(spark.createDataFrame([(1, "b")], "id long, v string"))
    table.compact()
    (tmp_path / "t/log/1/_SUCCESS").rename(tmp_path / "t/log/1/gone")
    (tmp_path / "t/lists/1/_SUCCESS").rename(tmp_path / "t/lists/1/gone")
    assert rows_of(table) == {1: "a"}
    table.append(spark.createDataFrame([(1, "c")], "id long, v string"))  # takes the place of the batch that failed
    assert rows_of(table) == {1: "c"} and finished_folders(spark, str(tmp_path / "none")) == []


# --- databases ----------------------------------------------------------------------------------------------------------


def test_database_table_in_ranges(spark):
    url, options = "jdbc:derby:memory:shelf;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    books = spark.range(1, 101).select(F.col("id").alias("BOOK_ID"), F.concat(F.lit("title "), "id").alias("TITLE"), (F.col("id") % 7).cast("int").alias("KIND"))
    books.write.jdbc(url, "BOOKS", properties=options)
    read = databases.read_table(spark, url, "BOOKS", "BOOK_ID", 5, **options)
    assert read.rdd.getNumPartitions() == 5 and sorted(map(tuple, read.collect())) == sorted(map(tuple, books.collect()))
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 25
    found = read.where("KIND = 3 AND TITLE LIKE 'title 1%'").select("BOOK_ID")
    assert "PushedFilters: [*IsNotNull(KIND), *IsNotNull(TITLE), *EqualTo(KIND,3), *StringStartsWith(TITLE,title 1)]" in plan_of(found) and "ReadSchema: struct<BOOK_ID:bigint>" in plan_of(found)
    assert sorted(r.BOOK_ID for r in found.collect()) == [10, 17]
    books.limit(0).write.jdbc(url, "NONE_YET", properties=options)
    assert databases.read_table(spark, url, "NONE_YET", "BOOK_ID", 5, **options).count() == 0


# --- collections --------------------------------------------------------------------------------------------------------


def test_partitions_without_a_scan(spark, tmp_path):
    chunks = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("category"), F.lit("x").alias("text"))
    files.write_collection(chunks, str(tmp_path))
    listed = files.partitions_of(spark, str(tmp_path))
    assert {r.partition: r.n for r in listed.collect()} == {"hot": 900, "c0": 34, "c1": 33, "c2": 33} and all("library.partitions" in f for f in listed.inputFiles())
    shutil.move(tmp_path / "library" / "category=c0", tmp_path / "away")  # names come from the catalogue, not from folders
    assert files.partition_names(spark, str(tmp_path)) == ["c0", "c1", "c2", "hot"]
    found = files.read_collection(spark, str(tmp_path), ["c1", "c2"])
    assert found.count() == 66 and "PartitionFilters: [category" in plan_of(found)


# --- pages and pieces ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["long", "string", "double", "timestamp"])
def test_deep_pages(spark, tmp_path, kind):
    value = {"long": "id * 7919 % 500", "string": "lpad(id * 7919 % 500, 4, '0')", "double": "id * 7919 % 500 / 3", "timestamp": "timestamp_seconds(id * 7919 % 500)"}[kind]
    rows = spark.range(2000).select(F.when(F.col("id") % 40 != 0, F.expr(value)).alias("o"), "id")
    rows.write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    every = [tuple(r) for r in rows.orderBy("o", "id").collect()]
    for offset in (0, 1, 30, 49, 50, 51, 999, 1985, 1999, 2000, 5000):
        assert [tuple(r) for r in catalog.deep_page(rows, ["o", "id"], offset, 20, ranges=16).collect()] == every[offset : offset + 20]
    if kind in ("long", "double"):
        assert "GreaterThan(o," in plan_of(catalog.deep_page(rows, ["o", "id"], 1500, 20, ranges=16))
    with pytest.raises(ValueError, match="limit"):
        catalog.deep_page(rows, ["o"], 0, 101)


def test_pieces(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 25), ("b", 10), (None, 11)) for i in range(n)], "k string, i int").repartition(4)
    got = scans.pieces(rows, ["k"], ["i"], 10).collect()
    assert all(r.piece == r.i // 10 for r in got) and len(got) == 46


# --- the sink -----------------------------------------------------------------------------------------------------------


def test_a_sink_that_is_started_again_holds_each_line_once(spark, tmp_path):
    """The first batch was written but not noted as done when the query was killed."""
    (tmp_path / "in").mkdir()
    asked = spark.createDataFrame([(str(i), f"reply number {i} of many") for i in range(40)], "request_id string, reply string")
    whole = replies.reply_lines(asked)
    whole.where("request_id < '2'").coalesce(1).write.json(str(tmp_path / "one"))
    whole.where("request_id >= '2'").coalesce(1).write.json(str(tmp_path / "two"))

    def give(name):
        for f in (tmp_path / name).glob("part-*"):
            f.rename(tmp_path / "in" / f"{name}.json")

    def run():
        lines = spark.readStream.schema(replies.LINE).json(str(tmp_path / "in"))
        sink.ndjson_sink(lines, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    give("one")
    run()
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    run()
    give("two")
    run()
    got = sink.read_sink(spark, str(tmp_path / "out"))
    assert sorted(map(repr, got.select("request_id", "seq", "type", "delta").collect())) == sorted(map(repr, whole.select("request_id", "seq", "type", "delta").collect()))
    for folder in (tmp_path / "out").iterdir():
        for f in folder.glob("part-*"):
            seqs = {}
            for r in spark.read.json(str(f)).select("request_id", "seq").collect():
                seqs.setdefault(r.request_id, []).append(r.seq)
            assert all(s == sorted(s) and len(s) == 7 for s in seqs.values())
