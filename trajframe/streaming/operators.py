"""Structured Streaming: sources, gates, queues of actions, rates and incremental stats. Windows and counters of episodes are in ``stateful``.

State is bounded per episode (a kept vector, the queue of actions to come) and leaves when a row that ``end`` marks as the episode's last has come, or when the
watermark has passed the episode's last event time by ``silence_ms``, if frames have an event-time column ``time``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_frames(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Frames as they arrive as files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def _keep(state: GroupState, rows: pd.DataFrame, end: str, value: tuple, silence_ms: int | None) -> None:
    """The state for the next batch, or none once the episode has ended; with a timeout if silence ends it too."""
    if bool(rows[end].any()):
        if state.exists:
            state.remove()
    else:
        state.update(value)
        if silence_ms is not None:
            state.setTimeoutTimestamp(max(int(rows["__ms"].max()), state.getCurrentWatermarkMs()) + silence_ms)


def _by_episode(frames: DataFrame, key: str, step, schema: str, kept: str, time: str | None, delay: str) -> DataFrame:
    """Without an event time, only end marks remove state."""
    if time is None:
        return frames.groupBy(key).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)
    rows = frames.withWatermark(time, delay).withColumn("__ms", F.unix_millis(F.col(time)))
    return rows.groupBy(key).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def similarity_gate(frames: DataFrame, cols: list[str], tolerance: float, key: str = "episode_index", order: str = "frame_index", end: str = "is_last", time: str | None = None, silence_ms: int = 3_600_000, delay: str = "1 hour") -> DataFrame:
    """(key, order) of frames not seen before and at least ``tolerance`` from the last kept one; state: that one and its step."""
    kinds, silence = dict(frames.dtypes), silence_ms if time else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, most = (list(state.get[0]), state.get[1]) if state.exists else ([], -1)
        out, rows = [], pd.concat(list(batches))
        for row in rows.sort_values(order)[[order, *cols]].itertuples(index=False):
            o, p = int(row[0]), [float(x) for x in row[1:]]
            if o <= most:
                continue
            most = o
            if kept and sum((x - y) ** 2 for x, y in zip(p, kept, strict=True)) ** 0.5 < tolerance:
                continue
            kept = p
            out.append((k[0], o))
        _keep(state, rows, end, (kept, most), silence)
        if out:
            yield pd.DataFrame(out, columns=[key, order])

    return _by_episode(frames, key, step, f"{key} {kinds[key]}, {order} long", "kept array<double>, most long", time, delay)


def late_actions(actions: DataFrame, key: str = "episode_index", step_col: str = "target", value: str = "value", executed: str = "executed", end: str = "is_last", time: str | None = None, silence_ms: int = 3_600_000, delay: str = "1 hour") -> DataFrame:
    """(key, target, value, late): actions at or before the last executed step are late; others are merged with the queued value. Progress reports count both
    under ``actions`` (``stateful.observed``)."""
    kinds, silence = dict(actions.dtypes), silence_ms if time else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        steps, values, high = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], -1)
        queue, out, rows = dict(zip(steps, values, strict=True)), [], pd.concat(list(batches))
        for t, v, x in rows.sort_values(executed, kind="stable")[[step_col, value, executed]].itertuples(index=False):
            high = max(high, int(x))
            late = int(t) <= high
            if not late:
                queue[int(t)] = 0.3 * queue[int(t)] + 0.7 * float(v) if int(t) in queue else float(v)
            out.append((k[0], int(t), float(v) if late else queue[int(t)], late))
        queue = {t: v for t, v in queue.items() if t > high}
        _keep(state, rows, end, (list(queue), list(queue.values()), high), silence)
        yield pd.DataFrame(out, columns=[key, step_col, value, "late"])

    schema = f"{key} {kinds[key]}, {step_col} long, {value} double, late boolean"
    found = _by_episode(actions, key, step, schema, "steps array<long>, vals array<double>, high long", time, delay)
    return found.observe("actions", F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("queued"))


def rates(frames: DataFrame, key: str, time: str) -> DataFrame:
    """(key, n, rate): rows a second so far, for update or complete mode."""
    agg = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    return agg.select(key, "n", ((F.col("n") - 1) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("rate"))


def incremental_stats(stream: DataFrame, cols: list[str], path: str, checkpoint: str):
    """Starts a query that adds each batch's stats and histograms to those stored under ``path``: a folder for each batch, so a repeated batch
    overwrites its own. Both merge in any order."""
    from trajframe.operators.histogram import batch_histograms
    from trajframe.operators.stats import per_episode_stats

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        per_episode_stats(batch, cols).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
        long = batch.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols))))
        batch_histograms(long, ["feature"], "v").write.mode("overwrite").parquet(f"{path}/histograms/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """Stats by feature of all batches so far, with quantiles from the merged histograms, whose range has grown with the batches."""
    from trajframe.operators.histogram import merge_histograms, quantiles_of
    from trajframe.operators.stats import QUANTILES, merge_stats, quantile_key

    merged = merge_stats(spark.read.parquet(f"{path}/stats").drop("batch"))
    found = quantiles_of(merge_histograms(spark.read.parquet(f"{path}/histograms").drop("batch"), ["feature"]), ["feature"])
    wide = found.groupBy("feature").agg(*(F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(quantile_key(q)) for q in QUANTILES))
    return merged.drop(*(quantile_key(q) for q in QUANTILES)).join(wide, "feature", "left")


def arrivals(rows: DataFrame, split: str, folder: str, key: str = "episode_index") -> int:
    """``rows`` written as files, those of a lower ``split`` first, each file with the whole of its episodes' rows of that part; how many files a part has at most.

    One write deals them to tasks by (part, key) and a folder for each part; the file source takes files by their time, so each part's are marked in turn."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.withColumn("__part", F.col(split)).drop(split).repartition(tasks, key).write.partitionBy("__part").parquet(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((int(p.getPath().getName().rpartition("=")[2]), p.getPath()) for p in fs.listStatus(root) if "=" in p.getPath().getName())
    most = 1
    for turn, (_, part) in enumerate(parts):
        files = fs.listStatus(part)
        most = max(most, len(files))
        for f in files:
            fs.setTimes(f.getPath(), 1_000_000_000_000 + turn * 60_000, -1)
    return most


def run_stream(spark: SparkSession, rows: DataFrame, split: str, transform, folder: str, mode: str = "append") -> tuple[DataFrame, list]:
    """Streams ``rows``, part by part, through ``transform``; what came out (in complete mode the last result), and the progress reports.

    A trigger takes as many files as the largest part has. A smaller part's trigger takes some of the next one too: rows of an episode still come in order."""
    source, sink, marks = f"{folder}/in", f"{folder}/out", f"{folder}/marks"
    files = arrivals(rows, split, source)
    stream = spark.readStream.schema(rows.drop(split).schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(source)
    writer = transform(stream).writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", sink)
    else:
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(sink))
    running = writer.start()
    running.awaitTermination()
    return spark.read.parquet(sink), [json.loads(p.json) if hasattr(p, "json") else p for p in running.recentProgress]


def replay(spark: SparkSession, rows: DataFrame, split: str, transform, folder: str, mode: str = "append") -> DataFrame:
    return run_stream(spark, rows, split, transform, folder, mode)[0]
