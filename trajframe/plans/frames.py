"""Queries over the data model: scans, look-ups, joins with dictionaries, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.operators import numbering, packing, windows
from trajframe.plans.registry import query
from trajframe.plans.views import episodes, frames, table, tasks


@query("""
, st AS (SELECT SUM(c) AS n, SUM(c * m) / SUM(c) AS mu FROM (SELECT episode_index, COUNT(*) AS c, AVG(s0) AS m FROM fr GROUP BY 1) x),
sd AS (SELECT n, mu, SQRT(SUM(c * (v + (m - mu) * (m - mu))) / n) AS sigma
       FROM (SELECT episode_index, COUNT(*) AS c, AVG(s0) AS m, VAR_POP(s0) AS v FROM fr GROUP BY 1) x, st GROUP BY n, mu),
z AS (SELECT episode_index, frame_index, length, task, (s0 - mu) / (sigma + 1e-8) AS z FROM fr, sd),
d AS (SELECT a.task, b.z - a.z AS d FROM z a JOIN z b ON a.episode_index = b.episode_index AND b.frame_index = a.frame_index + 50)
SELECT task, COUNT(*) AS n, ROUND(AVG(d), 4) AS mean_delta FROM d GROUP BY task
""")
def flagship_delta_by_task(spark, sf_dir):
    """Stats per episode, merged; values normalised; windows at [-1, 0, 1, 50]; mean change of unpadded frames by task."""
    from trajframe.operators.stats import merge_stats, per_episode_stats

    rows = frames(spark, sf_dir)
    merged = merge_stats(per_episode_stats(rows, ["s0"])).select("mean", "std")
    z = rows.crossJoin(F.broadcast(merged)).withColumn("z", (F.col("s0") - F.col("mean")) / (F.col("std") + 1e-8))
    ahead = windows.delta_window(z, "z", [-1, 0, 1, 50])
    ahead = ahead.where(~F.get("z_window_is_pad", F.lit(3)))
    return ahead.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("z_window", F.lit(3)) - F.get("z_window", F.lit(1))), 4).alias("mean_delta"))


@query("SELECT episode_index, frame_index, idx, ROUND(s0, 4) AS s0 FROM fr WHERE episode_index IN (3, 5, 8)")
def a1_frame_scan_episodes(spark, sf_dir):
    """The list of episodes reaches the scan of the frames as a pushed filter."""
    return frames(spark, sf_dir).where(F.col("episode_index").isin(3, 5, 8)).select("episode_index", "frame_index", "idx", F.round("s0", 4).alias("s0"))


@query("SELECT episode_index, length, dataset_from_index, dataset_to_index FROM ep")
def a2_episode_scan(spark, sf_dir):
    return episodes(spark, sf_dir)


@query("SELECT task, task_index FROM tk")
def a4_tasks(spark, sf_dir):
    return tasks(spark, sf_dir)


@query("SELECT CAST(x.k AS BIGINT) AS k FROM range(0, (SELECT MAX(episode_index) * 2 + 2 FROM ep)) x(k) LEFT JOIN ep ON ep.episode_index = x.k WHERE ep.episode_index IS NULL")
def a16_missing_shards(spark, sf_dir):
    """Of the numbers up to twice the largest, those that no episode has."""
    known = episodes(spark, sf_dir).select("episode_index")
    wanted = spark.range(known.agg(F.max("episode_index")).first()[0] * 2 + 2).withColumnRenamed("id", "k")
    return wanted.join(known, F.col("k") == F.col("episode_index"), "left_anti")


@query("""
, v AS (SELECT f.episode_index, COUNT(*) AS n, MIN(idx) AS lo, MAX(idx) + 1 AS hi FROM fr f GROUP BY 1)
SELECT ep.episode_index, v.n = ep.length AS length_ok, v.lo = ep.dataset_from_index AND v.hi = ep.dataset_to_index AS bounds_ok, v.hi - v.lo = v.n AS dense_ok
FROM ep LEFT JOIN v USING (episode_index)
""")
def a17_integrity(spark, sf_dir):
    from trajframe.sources.dataset import integrity

    return integrity(frames(spark, sf_dir), episodes(spark, sf_dir))


@query("SELECT length, COUNT(*) AS n FROM ep WHERE length > 60 GROUP BY length")
def b3_episode_predicate(spark, sf_dir):
    chosen = episodes(spark, sf_dir).where("length > 60")
    kept = frames(spark, sf_dir).join(chosen.select("episode_index"), "episode_index", "left_semi")
    return kept.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT episode_index, frame_index, task, event_id FROM fr WHERE idx = 123")
def b4_point_lookup(spark, sf_dir):
    return frames(spark, sf_dir).where("idx = 123").select("episode_index", "frame_index", "task", "event_id")


@query("SELECT task, COUNT(*) AS n, CAST(SUM(frame_index) AS BIGINT) AS total FROM fr GROUP BY task")
def c1_frame_task_join(spark, sf_dir):
    rows = frames(spark, sf_dir).drop("task").join(F.broadcast(tasks(spark, sf_dir)), "task_index")
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_index").alias("total"))


@query("SELECT episode_index, COUNT(*) AS n, CAST(SUM(CASE WHEN frame_index = length - 1 THEN 1 ELSE 0 END) AS BIGINT) AS last_frames FROM fr GROUP BY episode_index")
def c3_frame_episode_join(spark, sf_dir):
    rows = frames(spark, sf_dir).select("episode_index", "frame_index").join(episodes(spark, sf_dir), "episode_index")
    return rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("frame_index") == F.col("length") - 1).alias("last_frames"))


@query("""
, k AS (SELECT episode_index, length, ROW_NUMBER() OVER (ORDER BY episode_index) - 1 AS ne, CAST(SUM(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS nf FROM ep WHERE episode_index % 3 <> 0)
SELECT fr.episode_index, frame_index, ne AS new_episode_index, nf + frame_index AS new_index FROM fr JOIN k USING (episode_index)
""")
def e10_dense_renumbering(spark, sf_dir):
    kept = numbering.kept_episodes(episodes(spark, sf_dir).where("episode_index % 3 <> 0"))
    return numbering.renumber(frames(spark, sf_dir), kept).select("episode_index", "frame_index", "new_episode_index", "new_index")


@query("""
, f AS (SELECT episode_index, length, episode_index // 10 AS file FROM ep)
SELECT episode_index, file, CAST(SUM(length) OVER w - length AS BIGINT) AS from_in_file, CAST(SUM(length) OVER w AS BIGINT) AS to_in_file FROM f WINDOW w AS (PARTITION BY file ORDER BY episode_index)
""")
def e11_offsets_per_file(spark, sf_dir):
    rows = episodes(spark, sf_dir).select("episode_index", "length", F.floor(F.col("episode_index") / 10).alias("file"))
    return numbering.cumulative_offsets(rows, "length", "episode_index", "from_in_file", "to_in_file", "file").drop("length")


@query("""
, o AS (SELECT episode_index % 2 AS dataset, episode_index, length, ROW_NUMBER() OVER (PARTITION BY episode_index % 2 ORDER BY episode_index) AS r FROM ep),
p AS (
  SELECT dataset, episode_index, r, length AS filled, 0 AS file FROM o WHERE r = 1
  UNION ALL
  SELECT o.dataset, o.episode_index, o.r, CASE WHEN p.filled + o.length >= 500 THEN o.length ELSE p.filled + o.length END, CASE WHEN p.filled + o.length >= 500 THEN p.file + 1 ELSE p.file END
  FROM p JOIN o ON o.dataset = p.dataset AND o.r = p.r + 1)
SELECT dataset, episode_index, CAST(file // 4 AS BIGINT) AS chunk_index, CAST(file % 4 AS BIGINT) AS file_index FROM p
""")
def a9_file_packing(spark, sf_dir):
    rows = episodes(spark, sf_dir).withColumn("dataset", F.col("episode_index") % 2)
    return packing.pack_files(rows, 500.0, 4, size="length")


@query("""
, o AS (SELECT episode_index % 3 AS camera, episode_index, length, length * 0.5::DOUBLE AS mb, ROW_NUMBER() OVER (PARTITION BY episode_index % 3 ORDER BY episode_index) AS r FROM ep),
p AS (
  SELECT camera, episode_index, r, mb AS total, 1 AS n, length AS held, 0 AS batch FROM o WHERE r = 1
  UNION ALL
  SELECT camera, episode_index, r, CASE WHEN shut THEN mb ELSE total + mb END, CASE WHEN shut THEN 1 ELSE n + 1 END, CASE WHEN shut THEN length ELSE held + length END, CASE WHEN shut THEN batch + 1 ELSE batch END
  FROM (SELECT o.*, p.total, p.n, p.held, p.batch, p.total >= 200 OR p.n >= 8 OR p.held + o.length > 600 AS shut FROM p JOIN o ON o.camera = p.camera AND o.r = p.r + 1) q)
SELECT camera, episode_index, CAST(batch AS BIGINT) AS batch FROM p
""")
def f10_episode_batches(spark, sf_dir):
    rows = episodes(spark, sf_dir).withColumn("camera", F.col("episode_index") % 3).withColumn("mb", F.col("length") * 0.5)
    return packing.batch_episodes(rows, "camera", "episode_index", "mb", "length", 200.0, 8, 600)


@query("SELECT episode_index, COUNT(*) AS n_episode_frames, MIN(idx) AS first_idx, MAX(idx) + 1 AS end_idx, COUNT(DISTINCT task) AS n_tasks FROM fr GROUP BY episode_index")
def d9_episode_index(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("episode_index").agg(
        F.count(F.lit(1)).alias("n_episode_frames"), F.min("idx").alias("first_idx"), (F.max("idx") + 1).alias("end_idx"), F.size(F.collect_set("task")).cast("long").alias("n_tasks")
    )


@query("SELECT COUNT(*) AS n_episodes, (SELECT COUNT(*) FROM tk) AS n_tasks, CAST(SUM(length) AS BIGINT) AS n_frames, ROUND(AVG(length), 4) AS mean_frames, ROUND(AVG(length) / 30, 4) AS mean_seconds FROM ep")
def d10_summary(spark, sf_dir):
    one = episodes(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum("length").alias("n_frames"), F.round(F.avg("length"), 4).alias("mean_frames"), F.round(F.avg("length") / 30, 4).alias("mean_seconds")
    )
    return one.crossJoin(tasks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_tasks")))


@query("""
, x AS (SELECT (idx * 7) % ((SELECT MAX(dataset_to_index) FROM ep) + 50) AS i FROM fr)
SELECT COALESCE(ep.episode_index, -1) AS episode_index, COUNT(*) AS n, CAST(SUM(i - COALESCE(ep.dataset_from_index, 0)) AS BIGINT) AS total
FROM x LEFT JOIN ep ON x.i >= ep.dataset_from_index AND x.i < ep.dataset_to_index GROUP BY 1
""")
def c4_index_range_join(spark, sf_dir):
    """Indices over the whole table and somewhat beyond it, which belongs to no episode."""
    from trajframe.operators.align import index_join

    known = episodes(spark, sf_dir).select("episode_index", "dataset_from_index", "dataset_to_index")
    top = known.agg(F.max("dataset_to_index")).first()[0] + 50
    found = index_join(frames(spark, sf_dir).select(((F.col("idx") * 7) % top).alias("i")), known, "i", "dataset_from_index", "dataset_to_index", {"episode_index": -1, "dataset_from_index": 0})
    return found.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") - F.col("dataset_from_index")).alias("total"))


@query("SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_returnflag")
def c13_keep_orders(spark, sf_dir):
    """The semi-join form of keeping episodes, on the largest table: orders as episodes, lines as frames."""
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").join(kept, "l_orderkey", "left_semi")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))
