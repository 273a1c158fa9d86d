"""Many small files written by tasks: what lies in each, and that a task that is repeated changes nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.sources import dataset as D
from trajframe.streaming.storage import new_folder


def test_each_file_holds_its_rows_in_order(spark):
    """An episode over several Arrow batches, one of a single row, and a second writing of all."""
    rows = spark.range(30_000).select(F.when(F.col("id") == 7, 1234567).otherwise(F.col("id") % 2).alias("e"), (30_000 - F.col("id")).alias("o"), F.lit("a, \"b\"\n").alias("s"))
    folder = new_folder(spark)
    for _ in range(2):
        D.write_files(rows, folder, D.episode_file("e", "parquet"), ["o"])
    back = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    found = back.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"(chunk-.*)$", 1)).agg(F.count_distinct("e"), F.count("o")).collect()
    assert sorted(map(tuple, found)) == [("chunk-000/episode_000000.parquet", 1, 15_000), ("chunk-000/episode_000001.parquet", 1, 14_999), ("chunk-1234/episode_1234567.parquet", 1, 1)]
    orders = [r["o"] for r in spark.read.parquet(f"{folder}/chunk-000/episode_000000.parquet").collect()]
    assert orders == sorted(orders)
    csv = new_folder(spark)
    D.write_files(rows, csv, D.episode_file("e", "csv"), ["o"], ("e",))
    read = spark.read.option("header", "true").option("multiLine", "true").option("escape", "\"").csv(f"{csv}/chunk-*")
    assert (read.columns, read.count(), read.select("s").distinct().collect()[0][0]) == (["o", "s"], 30_000, "a, \"b\"\n")


def test_without_arrow_spark_writes(spark, monkeypatch):
    """Both layouts of the older format are read."""
    frames = spark.range(40).select((F.col("id") % 4).alias("episode_index"), F.floor(F.col("id") / 4).alias("frame_index"), F.lit("t").alias("task"), F.col("id").cast("double").alias("v"))
    tasks = spark.createDataFrame([("t", 0)], "task string, task_index long")
    got = []
    for uri in (D._arrow_uri, lambda *_: None):
        monkeypatch.setattr(D, "_arrow_uri", uri)
        root = new_folder(spark)
        D.write_legacy(frames, tasks, ["v"], root)
        data = D.convert_legacy(spark, root, 10, {"v": {"dtype": "float64", "shape": [1]}})
        got.append((sorted(map(tuple, data.frames.select("episode_index", "frame_index", "v").collect())), sorted(data.episodes.select("length").collect())))
    assert got[0] == got[1] and len(got[0][0]) == 40


def test_no_rows_leave_a_folder(spark):
    folder = new_folder(spark)
    none = spark.range(0).withColumnRenamed("id", "e")
    D.write_files(none, folder, D.episode_file("e", "parquet"), ["e"])
    assert spark.read.schema("e long").parquet(folder).count() == 0


def test_the_older_layouts_files_are_read_by_tasks(spark, tmp_path):
    """No scan of Spark's opens each of the files; rows and types are those that were written, and other names are still read."""
    rows = spark.range(600).selectExpr("id DIV 5 AS episode_index", "id % 5 AS frame_index", "IF(id % 7 = 0, NULL, 'a') AS task", "id * 0.5D AS s0", "timestamp_micros(id) AS at")
    root = f"file://{tmp_path}/old"
    D.write_legacy(rows, spark.sql("SELECT 'a' AS task, 0L AS task_index"), ["s0"], root)
    back = D.convert_legacy(spark, root, 30, {"s0": {"dtype": "float64", "shape": [1]}}).frames
    assert not back.inputFiles() or all("/data/" not in f for f in back.inputFiles())
    assert dict(back.dtypes) == dict(rows.dtypes)
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "old/data/chunk-000").rename(tmp_path / "old/data/part-000")
    moved = D.convert_legacy(spark, root, 30, {"s0": {"dtype": "float64", "shape": [1]}}).frames
    assert moved.count() == 600
