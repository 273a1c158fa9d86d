"""Queries over layouts: written datasets, older ones, shards, transitions, keys and structs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trajframe.functions import vectors as V
from trajframe.operators import stats as S
from trajframe.operators import structure as R
from trajframe.plans.registry import query
from trajframe.plans.views import episodes, events, frames, table, tasks
from trajframe.sources import dataset as D
from trajframe.sources.appendable import Appendable
from trajframe.streaming.storage import new_folder

KEYS = ("episode_index", "frame_index")


@query("SELECT episode_index, frame_index, idx AS index, task_index, ROUND(CAST(s0 AS FLOAT)::DOUBLE, 3) AS s0 FROM fr")
def a8_written_dataset(spark, sf_dir):
    """Events built to a dataset, written, and read back."""
    rows = events(spark, sf_dir).select("episode_index", "task", "us", "event_id", F.col("s0").cast("float").alias("s0"))
    root = new_folder(spark)
    D.build(rows, 30, ["us", "event_id"], {"s0": {"dtype": "float32", "shape": [1]}}).write(root)
    back = D.Dataset.read(spark, root).frames
    return back.select(*KEYS, "index", "task_index", F.round(F.col("s0").cast("double"), 3).alias("s0"))


def _legacy(spark, sf_dir, **packing):
    root = new_folder(spark)
    D.write_legacy(frames(spark, sf_dir).select(*KEYS, "task", "s0", "s1"), tasks(spark, sf_dir), ["s0", "s1"], root)
    return D.convert_legacy(spark, root, 30, {"s0": {"dtype": "float64", "shape": [1]}, "s1": {"dtype": "float64", "shape": [1]}}, **packing)


@query("SELECT ep.episode_index, length, dataset_from_index, dataset_to_index, x.tasks FROM ep JOIN (SELECT episode_index, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM fr GROUP BY 1) x USING (episode_index)")
def a10_legacy_episodes(spark, sf_dir):
    """The older layout read, its offsets found anew."""
    known = _legacy(spark, sf_dir).episodes
    return known.select("episode_index", "length", "dataset_from_index", "dataset_to_index", F.array_join("tasks", ",").alias("tasks"))


@query("""
, l AS (SELECT episode_index, 's0' AS feature, s0 AS v FROM fr UNION ALL SELECT episode_index, 's1', s1 FROM fr),
q AS (SELECT feature, episode_index, COUNT(*) AS n, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.99) AS q99 FROM l GROUP BY ALL),
w AS (SELECT feature, SUM(n * q01) / SUM(n) AS q01, SUM(n * q50) / SUM(n) AS q50, SUM(n * q99) / SUM(n) AS q99 FROM q GROUP BY 1)
SELECT l.feature, CAST(0 AS INTEGER) AS dim, COUNT(*) AS count, ROUND(MIN(v), 4) AS min, ROUND(MAX(v), 4) AS max, ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_POP(v), 4) AS std,
  ROUND(ANY_VALUE(q01) + 1e-8, 4) AS q01, ROUND(ANY_VALUE(q50) + 1e-8, 4) AS q50, ROUND(ANY_VALUE(q99) + 1e-8, 4) AS q99 FROM l JOIN w ON w.feature = l.feature GROUP BY 1
""")
def a11_converted_stats(spark, sf_dir):
    """The stats of all episodes of the older layout merged, with their quantiles."""
    found = _legacy(spark, sf_dir).stats
    return found.select("feature", "dim", "count", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")), *(F.round(F.col(c) + 1e-8, 4).alias(c) for c in ("q01", "q50", "q99")))


@query("""
, o AS (SELECT episode_index, length, ROW_NUMBER() OVER (ORDER BY episode_index) AS r FROM ep),
p AS (
  SELECT episode_index, r, length, length AS filled, 0 AS file FROM o WHERE r = 1
  UNION ALL
  SELECT o.episode_index, o.r, o.length, CASE WHEN p.filled + o.length >= 700 THEN o.length ELSE p.filled + o.length END, CASE WHEN p.filled + o.length >= 700 THEN p.file + 1 ELSE p.file END
  FROM p JOIN o ON o.r = p.r + 1)
SELECT CAST(file // 3 AS BIGINT) AS chunk_index, CAST(file % 3 AS BIGINT) AS file_index, CAST(1 AS BIGINT) AS n_files, COUNT(*) AS n_episodes, CAST(SUM(length) AS BIGINT) AS n_frames FROM p GROUP BY ALL
""")
def a11_converted_files(spark, sf_dir):
    """The older layout's file for each episode packed into files of a size, written, and counted by what lies in each of them."""
    data = _legacy(spark, sf_dir, file_bytes=700 * 40, frame_bytes=40, files_per_chunk=3)
    numbered = data.frames.join(data.episodes.select("episode_index", "dataset_from_index"), "episode_index").withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index")
    root = f"{new_folder(spark)}/data"
    D.Dataset(numbered, data.episodes, data.tasks, data.info, data.stats).write(root)
    back = spark.read.parquet(f"{root}/data").withColumn("f", F.col("_metadata.file_path"))
    found = back.groupBy("chunk_index", "file_index").agg(F.count_distinct("f").alias("n_files"), F.count_distinct("episode_index").alias("n_episodes"), F.count(F.lit(1)).alias("n_frames"))
    return found.select(F.col("chunk_index").cast("long").alias("chunk_index"), F.col("file_index").cast("long").alias("file_index"), "n_files", "n_episodes", "n_frames")


@query("SELECT CAST(episode_index AS VARCHAR) AS episode, COUNT(*) AS n, ROUND(SUM(s0), 3) AS total, ROUND(MIN(t), 3) AS first FROM fr GROUP BY 1")
def a12_csv_streams(spark, sf_dir):
    """A folder of CSV files for each episode, with a time column, a number and a text."""
    root = new_folder(spark)
    rows = frames(spark, sf_dir).select(F.col("episode_index").alias("episode"), F.round("t", 6).alias("Time"), F.round("s0", 6).alias("s0"), "task")
    try:
        D.write_files(rows, root, D.episode_file("episode", "csv"), ["Time"], ("episode",))
        read = D.read_streams(spark, f"{root}/chunk-*", r"episode_0*([0-9]+)\.csv$")
    except OSError:
        rows.repartition("episode").write.partitionBy("episode").option("header", "true").csv(root)
        read = D.read_streams(spark, f"{root}/*/*.csv", r"episode=([^/]+)/")
    if read.columns != ["episode", "timestamp", "s0"]:
        raise ValueError(f"columns {read.columns}")
    return read.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s0"), 3).alias("total"), F.round(F.min("timestamp"), 3).alias("first"))


@query("SELECT idx, ROUND(coalesce((s0 - lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index)) / 0.1::DOUBLE, 0), 3) AS vel_s0 FROM fr")
def a15_sharded_job(spark, sf_dir):
    """Velocities in three shards, of which one is there already, read as one: the rows of the job as a whole."""
    from trajframe.operators.windows import velocity

    job = lambda part: velocity(part, ["s0"], 0.1).select("episode_index", "idx", F.round("vel_s0", 3).alias("vel_s0"))
    rows, folder = frames(spark, sf_dir).select(*KEYS, "idx", "s0"), f"{new_folder(spark)}/shards"
    R.run_sharded(rows.where("episode_index % 3 = 1"), job, 3, folder)
    return R.run_sharded(rows, job, 3, folder).select("idx", "vel_s0")


@query("""
, g AS (SELECT episode_index % 3 AS k, CASE WHEN episode_index % 3 = 0 THEN NULL ELSE ROUND(AVG(s0), 4) END AS success, ROUND(SUM(s1), 2) AS reward FROM fr GROUP BY episode_index % 3)
SELECT k, success, reward FROM g
""")
def a19_evaluation_reports(spark, sf_dir):
    """A report for each of three groups: one has NaN for its success."""
    root = new_folder(spark)
    rows = frames(spark, sf_dir).groupBy((F.col("episode_index") % 3).alias("k")).agg(F.round(F.avg("s0"), 4).alias("s"), F.round(F.sum("s1"), 2).alias("r")).collect()
    for r in rows:
        report = {"aggregated" if r["k"] % 2 else "overall": {"pc_success": float("nan") if r["k"] == 0 else r["s"], "avg_sum_reward": r["r"]}}
        spark.createDataFrame([(json.dumps(report, indent=1),)], "value string").coalesce(1).write.text(f"{root}/k={r['k']}")
    found = None
    for r in rows:
        one = D.flatten_evaluation(spark, f"{root}/k={r['k']}").select(F.lit(r["k"]).alias("k"), "success", "reward")
        found = one if found is None else found.unionByName(one)
    return found


@query("""
, e AS (SELECT *, task = 'purchase' OR frame_index % 40 = 39 AS fin FROM fr),
s AS (SELECT *, coalesce(SUM(CASE WHEN fin THEN 1 ELSE 0 END) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e)
SELECT event_id, DENSE_RANK() OVER (ORDER BY episode_index, seg) - 1 AS episode_index, ROW_NUMBER() OVER (PARTITION BY episode_index, seg ORDER BY frame_index) - 1 AS frame_index, idx AS index FROM s
""")
def a20_transitions_to_episodes(spark, sf_dir):
    """Users as environments: a purchase ends an episode, forty steps truncate it, the rest is an episode too."""
    rows = frames(spark, sf_dir).select(F.col("episode_index").alias("env"), F.col("frame_index").alias("step"), "event_id", "task")
    out = D.transitions_to_episodes(rows, "env", ["step"], (F.col("task") == "purchase") | (F.col("step") % 40 == 39))
    return out.select("event_id", *KEYS, "index")


@query("SELECT ROUND(s0, 4) AS state, ROUND(s1, 4) AS k, ROUND(s0 + s1, 4) AS action, frame_index = 0 AS action_is_pad, task, idx AS index FROM fr")
def b18_regroup_and_back(spark, sf_dir):
    """Columns grouped to transitions, read from the structs, and ungrouped again."""
    rows = frames(spark, sf_dir).select(F.round("s0", 4).alias("observation.state"), F.round("s1", 4).alias("observation.k"), F.round(F.col("s0") + F.col("s1"), 4).alias("action"), (F.col("frame_index") == 0).alias("action_is_pad"), "task", F.col("idx").alias("index"))
    grouped = R.regroup(rows)
    if sorted(grouped.columns) != ["action", "complementary", "observation"]:
        raise ValueError(f"columns {grouped.columns}")
    back = R.ungroup(grouped.withColumn("action", F.col("action") + F.col("observation.state") - F.col("observation.state")))
    return back.select(F.col("`observation.state`").alias("state"), F.col("`observation.k`").alias("k"), F.round("action", 4).alias("action"), "action_is_pad", "task", "index")


@query("""
, k AS (SELECT episode_index, length, ROW_NUMBER() OVER (ORDER BY episode_index) - 1 AS new_episode_index, CAST(SUM(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS f FROM ep WHERE episode_index % 2 = 0)
SELECT k.episode_index, new_episode_index, ROUND(f / 30.0::DOUBLE, 5) AS from_timestamp, ROUND((f + k.length) / 30.0::DOUBLE, 5) AS to_timestamp, COUNT(*) AS n FROM k JOIN fr ON fr.episode_index = k.episode_index GROUP BY ALL
""")
def g8_images_to_pointers(spark, sf_dir):
    """Every other episode, its second column taken as the image."""
    rows, known, _ = D.images_to_pointers(frames(spark, sf_dir), episodes(spark, sf_dir), ["s1"], 30.0, F.col("episode_index") % 2 == 0)
    if "s1" in rows.columns:
        raise ValueError("the image column is still there")
    counts = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: F.round(F.col(f"`videos/s1/{s}_timestamp`"), 5).alias(f"{s}_timestamp")
    return known.select("episode_index", "new_episode_index", side("from"), side("to")).join(counts, "episode_index")


@query("""
, l AS (SELECT 's0' AS feature, s0 AS v FROM fr UNION ALL SELECT 's1', s1 FROM fr), m AS (SELECT feature, MIN(v) AS min, MAX(v) AS max, AVG(v) AS mean FROM l GROUP BY 1)
SELECT 'stats/' || feature || '/min' AS key, ROUND(min, 4) AS value FROM m UNION ALL SELECT 'stats/' || feature || '/max', ROUND(max, 4) FROM m UNION ALL SELECT 'stats/' || feature || '/mean', ROUND(mean, 4) FROM m
""")
def h13_flat_keys(spark, sf_dir):
    """Stats under flat keys; back in rows and flat again they are the same."""
    merged = S.merge_stats(S.per_episode_stats(frames(spark, sf_dir), ["s0", "s1"])).select("feature", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean")))
    flat = R.flatten_keys(merged, "feature")
    return R.flatten_keys(R.unflatten_keys(flat, "feature", ["min", "max", "mean"]), "feature")


@query("SELECT vec_id, ROUND(embedding[46]::DOUBLE / 255, 9) AS green, ROUND(embedding[1]::DOUBLE / 255, 9) AS red, CAST(3 AS INTEGER) AS planes FROM embeddings")
def h18_pixel_scaling(spark, sf_dir):
    """The 64 numbers as 4 x 4 pixels of four channels, three of which become planes of parts of one."""
    every = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(F.col("embedding").cast("array<double>"), r * 16 + c * 4 + 1, 4)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.channels_first(every).alias("p"))
    at = lambda k, r, c: F.get(F.get(F.get("p", F.lit(k)), F.lit(r)), F.lit(c))
    return rows.select("vec_id", F.round(at(1, 2, 3), 9).alias("green"), F.round(at(0, 0, 0), 9).alias("red"), F.size("p").alias("planes"))


def _appended(spark, sf_dir):
    """The events appended as three batches of episodes; the second comes twice, and a writer of the third is lost before it commits."""
    rows = events(spark, sf_dir).select("episode_index", "task", "us", "event_id", "s0")
    top = episodes(spark, sf_dir).agg(F.max("episode_index")).first()[0] + 1
    third = lambda k: rows.where(F.floor(F.col("episode_index") * 3 / top) == k)
    store = Appendable.create(spark, f"{new_folder(spark)}/data", 30, {"s0": {"dtype": "float64", "shape": [1]}}, file_bytes=500 * 64, files_per_chunk=4)
    put = lambda k, how: how(third(k), f"part-{k}", ["us", "event_id"], frame_bytes=64)
    for k, how in ((0, store.append), (1, store.append), (1, store.append), (2, store.stage), (2, store.append)):
        put(k, how)
    return store.read()


@query("SELECT DENSE_RANK() OVER (ORDER BY episode_index) - 1 AS episode_index, frame_index, idx AS index, task, ROUND(s0, 4) AS s0 FROM fr")
def a8_appended_frames(spark, sf_dir):
    back = _appended(spark, sf_dir)
    return back.frames.join(back.tasks, "task_index").select(*KEYS, "index", "task", F.round("s0", 4).alias("s0"))


@query("""
, o AS (SELECT b, episode_index, length, dataset_from_index, ROW_NUMBER() OVER (PARTITION BY b ORDER BY episode_index) AS r
        FROM (SELECT *, episode_index * 3 // (SELECT MAX(episode_index) + 1 FROM ep) AS b FROM ep) x),
p AS (
  SELECT b, episode_index, r, length, length AS filled, 0 AS file FROM o WHERE r = 1
  UNION ALL
  SELECT o.b, o.episode_index, o.r, o.length, CASE WHEN p.filled + o.length >= 500 THEN o.length ELSE p.filled + o.length END, CASE WHEN p.filled + o.length >= 500 THEN p.file + 1 ELSE p.file END
  FROM p JOIN o ON o.b = p.b AND o.r = p.r + 1),
f AS (SELECT b, SUM(MAX(file) + 1) OVER (ORDER BY b) - MAX(file) - 1 AS base FROM p GROUP BY b)
SELECT CAST((base + file) // 4 AS BIGINT) AS chunk_index, CAST((base + file) % 4 AS BIGINT) AS file_index, COUNT(*) AS n_episodes, CAST(SUM(length) AS BIGINT) AS n_frames
FROM p JOIN f USING (b) GROUP BY 1, 2
""")
def a8_appended_files(spark, sf_dir):
    """What each file holds, counted over the frames that are read from it."""
    back = _appended(spark, sf_dir)
    per = back.frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    rows = back.episodes.select("episode_index", "chunk_index", "file_index").join(per, "episode_index")
    return rows.groupBy("chunk_index", "file_index").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("n_frames"))
