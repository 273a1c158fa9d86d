"""The events table seen as trajectories: users are episodes, their events frames, event types tasks.

Frames, episodes and tasks are derived from the events once for each session and state of the events' files, and written as Parquet to the shared
folder, as a dataset would hold them; queries scan that. ``VIEWS`` gives the same tables to the oracle, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajframe.operators.numbering import cumulative_offsets
from trajframe.streaming.storage import kept, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("episode_index"),
        "event_id",
        F.col("event_type").alias("task"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").alias("s0"),
        F.get_json_object("props", "$.k").cast("double").alias("s1"),
    )


#: Where the derived tables of a session lie, by application, source folder, name and the state of the source's files.
_WRITTEN: dict[tuple[str, str, str, str], str] = {}


def state(spark, path: str) -> str:
    """The names, sizes and times of a table's files: other files, other derived tables."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(where)))


def written(spark, sf_dir, name: str, derive, key: str) -> DataFrame:
    """A derived table, written at its first use: clustered by ``key``, so that filters on it and on what rises with it skip files and row groups."""
    at = (spark.sparkContext.applicationId, sf_dir, name, state(spark, f"{sf_dir}/events.parquet"))
    if at not in _WRITTEN or not kept(spark, _WRITTEN[at]):
        path = f"{new_folder(spark)}/{name}"
        rows = derive(spark, sf_dir)
        rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
        _WRITTEN[at] = path
    return spark.read.parquet(_WRITTEN[at])


def episodes(spark, sf_dir) -> DataFrame:
    """(episode_index, length, dataset_from_index, dataset_to_index)"""
    return written(spark, sf_dir, "episodes", _episodes, "episode_index")


def _episodes(spark, sf_dir) -> DataFrame:
    lengths = events(spark, sf_dir).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return cumulative_offsets(lengths, "length", "episode_index", "dataset_from_index", "dataset_to_index")


def tasks(spark, sf_dir) -> DataFrame:
    """(task, task_index): one row for each kind of event, so its window needs no partition."""
    return written(spark, sf_dir, "tasks", _tasks, "task_index")


def _tasks(spark, sf_dir) -> DataFrame:
    kinds = events(spark, sf_dir).select("task").distinct()
    return kinds.withColumn("task_index", (F.row_number().over(Window.orderBy("task")) - 1).cast("long"))


def frames(spark, sf_dir) -> DataFrame:
    """(episode_index, frame_index, idx, us, t, event_id, task, task_index, s0, s1, length, dataset_from_index)"""
    return written(spark, sf_dir, "frames", _frames, "idx")


def _frames(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("episode_index").orderBy("us", "event_id")
    rows = events(spark, sf_dir).withColumn("frame_index", (F.row_number().over(order) - 1).cast("long"))
    known = episodes(spark, sf_dir).select("episode_index", "length", "dataset_from_index")
    rows = rows.join(known, "episode_index").join(F.broadcast(tasks(spark, sf_dir)), "task")
    return rows.select(
        "episode_index",
        "frame_index",
        (F.col("dataset_from_index") + F.col("frame_index")).alias("idx"),
        "us",
        (F.col("us") / 1e6).alias("t"),
        "event_id",
        "task",
        "task_index",
        "s0",
        "s1",
        "length",
        "dataset_from_index",
    )


def half_of(spark, sf_dir) -> int:
    """The episode at which the second of two halves begins."""
    return (episodes(spark, sf_dir).agg(F.max("episode_index")).first()[0] + 1) // 2


VIEWS = """
WITH RECURSIVE ev AS (
  SELECT user_id AS episode_index, event_id, event_type AS task, epoch_us(ts) AS us, value AS s0,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s1 FROM events),
ep AS (
  SELECT episode_index, length, CAST(SUM(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS dataset_from_index,
         CAST(SUM(length) OVER (ORDER BY episode_index) AS BIGINT) AS dataset_to_index
  FROM (SELECT episode_index, COUNT(*) AS length FROM ev GROUP BY episode_index) x),
tk AS (SELECT task, ROW_NUMBER() OVER (ORDER BY task) - 1 AS task_index FROM (SELECT DISTINCT task FROM ev) x),
fr AS (
  SELECT ev.episode_index, ROW_NUMBER() OVER w - 1 AS frame_index, ep.dataset_from_index + ROW_NUMBER() OVER w - 1 AS idx,
         ev.us, ev.us / 1e6 AS t, ev.event_id, ev.task, tk.task_index, ev.s0, ev.s1, ep.length, ep.dataset_from_index
  FROM ev JOIN ep USING (episode_index) JOIN tk USING (task)
  WINDOW w AS (PARTITION BY ev.episode_index ORDER BY ev.us, ev.event_id))
"""
