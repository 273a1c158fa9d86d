"""Columns by prefix as structs and back, nested keys as paths and back, jobs in shards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that go with a transition without being part of it, beside those that end in _is_pad.
COMPLEMENTARY = ("task", "index", "task_index", "episode_index", "frame_index", "timestamp", "subtask")


def regroup(frames: DataFrame, prefix: str = "observation") -> DataFrame:
    """A transition in each row: the columns ``prefix``.* as one struct, those about it as ``complementary``, all others as they are."""
    inner = [c for c in frames.columns if c.startswith(f"{prefix}.")]
    about = [c for c in frames.columns if c in COMPLEMENTARY or c.endswith("_is_pad")]
    rest = [c for c in frames.columns if c not in inner and c not in about]
    named = [(prefix, [(c.removeprefix(f"{prefix}."), c) for c in inner]), ("complementary", [(c, c) for c in about])]
    structs = [F.struct(*(F.col(f"`{c}`").alias(n) for n, c in fields)).alias(name) for name, fields in named if fields]
    return frames.select(*structs, *(F.col(f"`{c}`") for c in rest))


def ungroup(transitions: DataFrame, prefix: str = "observation") -> DataFrame:
    """The columns of ``regroup`` again, those of the structs first."""
    kinds = {f.name: f.dataType for f in transitions.schema}
    out = [F.col(f"{prefix}.`{n}`").alias(f"{prefix}.{n}") for n in kinds[prefix].names] if prefix in kinds else []
    out += [F.col(f"complementary.`{n}`").alias(n) for n in kinds["complementary"].names] if "complementary" in kinds else []
    return transitions.select(*out, *(F.col(f"`{c}`") for c in kinds if c not in (prefix, "complementary")))


def flatten_keys(rows: DataFrame, key: str, root: str = "stats", sep: str = "/") -> DataFrame:
    """(key, value): a row of numbers by name becomes a row for each, under root/name/column."""
    cols = [c for c in rows.columns if c != key]
    path = lambda c: F.concat_ws(sep, F.lit(root), F.col(key), F.lit(c))
    return rows.select(F.inline(F.array(*(F.struct(path(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols))))


def unflatten_keys(rows: DataFrame, key: str, cols: list[str], sep: str = "/") -> DataFrame:
    """The rows of ``flatten_keys`` again: what stands between the first and the last separator names the row, the last part the column."""
    parts = F.split("key", sep)
    named = rows.select(F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), sep).alias(key), F.element_at(parts, -1).alias("__c"), "value")
    return named.groupBy(key).pivot("__c", cols).agg(F.first("value"))


def run_sharded(frames: DataFrame, job: Callable[[DataFrame], DataFrame], world: int, folder: str, episode: str = "episode_index") -> DataFrame:
    """``job`` over all episodes as one Spark job that writes a folder for each shard (episode mod world), and all shards read as one. The job keeps ``episode``.

    A run that was cut short leaves no finished attempt, and one over some of the shards those shards: the next run takes on what no finished attempt holds."""
    spark = frames.sparkSession
    shard = F.pmod(F.col(episode), F.lit(world)).cast("int")
    done = finished_shards(spark, folder)
    missing = sorted(set(range(world)) - {n for _, n in done})
    if missing:
        path = f"{folder}/attempt-{uuid.uuid4().hex}"
        job(frames.where(shard.isin(missing))).withColumn("shard", shard).write.partitionBy("shard").parquet(path)
        done = finished_shards(spark, folder)
    if not done:
        return job(frames.limit(0))
    return spark.read.parquet(*(f"{p}/shard={n}" for p, n in done))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The folders and files in a folder, by name; none where there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(where)) if fs.exists(where) else []


def finished_shards(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(attempt, shard) of what finished attempts have written."""
    found = []
    for attempt in listed(spark, folder):
        names = [p.rpartition("/")[2] for p in listed(spark, attempt)]
        if "_SUCCESS" in names:
            found += [(attempt, int(n.rpartition("=")[2])) for n in names if n.startswith("shard=")]
    return found
