"""Rejected CSV lines, batches that count once, overwrites of touched partitions, stored sketches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paysift.operators import aggregates as A
from paysift.sources import files as IO

SCHEMA = "id long, d date, x double, s string"


def test_rejected_lines_by_file_and_reason(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "one.csv").write_text("id,d,x,s\n1,2024-01-02,1.5,ok\n2,2024-02-30,x,two faults\n3,,,\n4,2024-01-01\n")
    (b / "two.csv").write_text("id,d,x,s\nq,2024-01-01,2,bad id\n5,2024-01-01,2, spaced \n6,2024-01-01,2,a,b\n")
    typed, rejected = IO.read_csv_checked(spark, str(tmp_path / "*" / "*.csv"), SCHEMA)
    assert sorted(map(tuple, typed.collect())) == [(1, dt.date(2024, 1, 2), 1.5, "ok"), (3, None, None, None), (5, dt.date(2024, 1, 1), 2.0, " spaced ")]
    got = {(r["source_file"], tuple(r["reasons"])): r["line"] for r in rejected.collect()}
    assert got == {("a/one.csv", ("d: not a date", "x: not a double")): "2,2024-02-30,x,two faults", ("a/one.csv", ("wrong number of fields",)): "4,2024-01-01",
                   ("b/two.csv", ("id: not a bigint",)): "q,2024-01-01,2,bad id", ("b/two.csv", ("wrong number of fields",)): "6,2024-01-01,2,a,b"}
    assert rejected.select("reasons").count() == 4 and typed.select("id").count() == 3


def log_rows(spark, ids):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3, 5)) for i in ids], "user_id long, created_at timestamp_ntz")


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        IO.read_log(spark, path)
    assert IO.append_batch(log_rows(spark, range(5)), path, "a")
    assert not IO.append_batch(log_rows(spark, range(5)), path, "a")  # repeated
    assert IO.append_batch(log_rows(spark, range(5, 8)), path, "b")
    back = IO.read_log(spark, path)
    assert sorted(r["user_id"] for r in back.collect()) == list(range(8)) and {r["batch"] for r in back.collect()} == {"a", "b"}
    assert IO.batches(spark, path) == ["a", "b"]
    with pytest.raises(ValueError):
        IO.append_batch(log_rows(spark, [1]), path, "../a")


def test_a_torn_batch_is_not_read_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    IO.append_batch(log_rows(spark, [1, 2]), path, "a")
    bad = log_rows(spark, range(10, 30)).repartition(4).withColumn(
        "user_id", F.when(F.col("user_id") == 25, F.raise_error(F.lit("lost"))).otherwise(F.col("user_id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        IO.append_batch(bad, path, "b")
    assert sorted(r["user_id"] for r in IO.read_log(spark, path).collect()) == [1, 2]
    # whole files, but the call broke off before the manifest
    real = IO._file_system
    class Broken:
        def __init__(self, fs): self.fs = fs
        def create(self, *a): raise OSError("gone")
        def __getattr__(self, n): return getattr(self.fs, n)
    monkeypatch.setattr(IO, "_file_system", lambda s, p: (Broken(real(s, p)[0]), *real(s, p)[1:]))
    with pytest.raises(OSError):
        IO.append_batch(log_rows(spark, [7, 8]), path, "c")
    monkeypatch.undo()
    assert sorted(r["user_id"] for r in IO.read_log(spark, path).collect()) == [1, 2]
    assert IO.append_batch(log_rows(spark, [7, 9]), path, "c")
    assert sorted(r["user_id"] for r in IO.read_log(spark, path).collect()) == [1, 2, 7, 9]


def test_overwrite_of_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(2020, 1), (2021, 2), (None, 3), (2021, 4)], "y int, v int")
    IO.write_parquet(rows, path, partition_by=["y"])
    IO.write_parquet(spark.createDataFrame([(2021, 9), (2022, 5)], "y int, v int"), path, partition_by=["y"], touched_only=True)
    assert sorted((r["y"] or 0, r["v"]) for r in spark.read.parquet(path).collect()) == [(0, 3), (2020, 1), (2021, 9), (2022, 5)]
    IO.write_parquet(spark.createDataFrame([(2021, 1)], "y int, v int"), path, partition_by=["y"])
    assert [(r["y"], r["v"]) for r in spark.read.parquet(path).collect()] == [(2021, 1)]


def test_sketches_merge_to_the_whole_count(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select((F.col("id") % 17).alias("day"), (F.col("id") * 7919 % 40_000).alias("u"), F.lit(None).cast("string").alias("none"), (F.col("id") % 5).cast("string").alias("few"))
    path = str(tmp_path / "sketches")
    A.distinct_sketches(df, ["day"], ["u", "none", "few"]).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 17
    whole = A.nunique_from_sketches(stored, ["u", "none", "few"]).first()
    exact = A.nunique(df, ["u", "none", "few"]).first()
    assert abs(whole["n_u"] / exact["n_u"] - 1) < 4 * A.SKETCH_ERROR and (whole["n_none"], whole["n_few"]) == (0, 5)
    part = {r["day"]: r["n_u"] for r in A.nunique_from_sketches(stored.where("day < 2"), ["u"], ["day"]).collect()}
    true = {r["day"]: r["n"] for r in df.where("day < 2").groupBy("day").agg(F.count_distinct("u").alias("n")).collect()}
    assert all(abs(part[d] / true[d] - 1) < 4 * A.SKETCH_ERROR for d in true)
