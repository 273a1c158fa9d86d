"""Queries over dataset edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajframe.operators import edit as E
from trajframe.plans.registry import query
from trajframe.plans.views import episodes, frames, half_of, table, tasks


def _parts(spark, sf_dir):
    """The frames in two datasets (frames, tasks, episodes), each numbered from 0: the first half of the episodes and the others."""
    rows, known, half = frames(spark, sf_dir).select("episode_index", "frame_index", "task", "s0"), episodes(spark, sf_dir), half_of(spark, sf_dir)
    out = []
    for own in (F.col("episode_index") < half, F.col("episode_index") >= half):
        kept = E.kept_episodes(known.where(own))
        part = E.renumber(rows.where(own), kept)
        kinds = rows.where(own).select("task").distinct().withColumn("task_index", (F.row_number().over(Window.orderBy("task")) - 1).cast("long"))
        part = part.join(F.broadcast(kinds), "task").select(F.col("new_episode_index").alias("episode_index"), "frame_index", F.col("new_index").alias("index"), "task_index", "s0")
        out.append((part, kinds, kept.select(F.col("new_episode_index").alias("episode_index"), "length")))
    return out


_HALF = ", h AS (SELECT (MAX(episode_index) + 1) // 2 AS h FROM ep)"


@query(_HALF + """, o AS (SELECT task, MIN(CASE WHEN episode_index < h THEN 0 ELSE 1 END) AS p FROM fr, h GROUP BY 1), n AS (SELECT task, ROW_NUMBER() OVER (ORDER BY p, task) - 1 AS task_index FROM o)
SELECT episode_index, frame_index, idx AS index, n.task_index, task, ROUND(s0, 4) AS s0, CASE WHEN episode_index < h THEN 0 ELSE 1 END AS dataset_index FROM fr JOIN n USING (task), h""")
def g1_merge_datasets(spark, sf_dir):
    """Splitting and merging again gives the frames back: episodes and indices shift to where they were."""
    merged, _ = E.merge_datasets(_parts(spark, sf_dir))
    return merged.select("episode_index", "frame_index", "index", "task_index", "task", F.round("s0", 4).alias("s0"), "dataset_index")


@query(_HALF + "SELECT CASE WHEN episode_index < h THEN 0 ELSE 1 END AS dataset_index, COUNT(*) AS n, ROUND(SUM(s0), 2) AS total FROM fr, h GROUP BY 1")
def g2_concatenated_view(spark, sf_dir):
    (a, *_), (b, *_) = _parts(spark, sf_dir)
    both = E.common_features([a.withColumn("only_here", F.lit(1)), b])
    return both.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s0"), 2).alias("total"))


@query("""
, k AS (SELECT episode_index, ROW_NUMBER() OVER (ORDER BY episode_index) - 1 AS ne, CAST(SUM(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS nf FROM ep WHERE episode_index NOT IN (0, 7, 12))
SELECT event_id, ne AS new_episode_index, nf + frame_index AS new_index FROM fr JOIN k USING (episode_index)
""")
def g4_delete_episodes(spark, sf_dir):
    return E.delete_episodes(frames(spark, sf_dir), [0, 7, 12], episodes(spark, sf_dir)).select("event_id", "new_episode_index", "new_index")


@query("""
, x AS (SELECT episode_index, CASE WHEN episode_index % 10 = 0 THEN 'override' ELSE arg_min(task, frame_index) END AS task FROM fr GROUP BY 1),
d AS (SELECT task, ROW_NUMBER() OVER (ORDER BY task) - 1 AS task_index FROM (SELECT DISTINCT task FROM x) y)
SELECT x.task, d.task_index, COUNT(*) AS n FROM fr JOIN x ON x.episode_index = fr.episode_index JOIN d ON d.task = x.task GROUP BY ALL
""")
def g5_retask(spark, sf_dir):
    over = episodes(spark, sf_dir).where("episode_index % 10 = 0").select("episode_index", F.lit("override").alias("task"))
    rows, _ = E.retask(frames(spark, sf_dir), overrides=over)
    return rows.groupBy("task", "task_index").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT task, task_index FROM tk UNION ALL SELECT o_orderstatus, 4 + ROW_NUMBER() OVER (ORDER BY o_orderstatus) FROM (SELECT DISTINCT o_orderstatus FROM orders) x")
def g6_register_tasks(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("task")).unionByName(tasks(spark, sf_dir).select("task"))
    return E.register_tasks(tasks(spark, sf_dir), new)


@query("SELECT episode_index, frame_index, ROUND(s0 * 2 + s1, 4) AS score FROM fr")
def b8_add_feature(spark, sf_dir):
    rows = E.modify_features(frames(spark, sf_dir), {"score": F.round(F.col("s0") * 2 + F.col("s1"), 4)}, ["s0", "s1"])
    return rows.select("episode_index", "frame_index", "score")


@query("SELECT idx, ROUND(idx % 7 + 0.5::DOUBLE, 2) AS bonus FROM fr")
def b7_add_feature_values(spark, sf_dir):
    rows = frames(spark, sf_dir)
    values = rows.select("idx", F.round(F.col("idx") % 7 + 0.5, 2).alias("bonus"))
    return E.add_feature_values(rows.select("idx"), values, "idx")


@query("""
, n AS (SELECT episode_index, ROW_NUMBER() OVER (ORDER BY episode_index) - 1 AS k, COUNT(*) OVER () AS c FROM ep)
SELECT episode_index, CASE WHEN k < CAST(floor(c * 0.6) AS BIGINT) THEN 'train' WHEN k < CAST(floor(c * 0.6) AS BIGINT) + CAST(floor(c * 0.2) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM n
""")
def f7_split_by_fraction(spark, sf_dir):
    return E.split_by_fraction(episodes(spark, sf_dir), {"train": 0.6, "val": 0.2, "test": 0.1})


@query("""
SELECT episode_index, CASE WHEN episode_index IN (1, 4, 9) THEN 'a' ELSE 'b' END AS split,
  ROW_NUMBER() OVER (PARTITION BY episode_index IN (1, 4, 9) ORDER BY episode_index) - 1 AS new_episode_index FROM ep WHERE episode_index IN (1, 4, 9, 2, 6)
""")
def f8_split_by_lists(spark, sf_dir):
    return E.split_by_lists(episodes(spark, sf_dir), {"a": [1, 4, 9], "b": [2, 6]})


@query("SELECT episode_index FROM ep WHERE episode_index >= (SELECT COUNT(*) FROM ep) - greatest(1, CAST(round_even((SELECT COUNT(*) FROM ep) * 0.15, 0) AS BIGINT))")
def f9_hold_out(spark, sf_dir):
    return E.hold_out(episodes(spark, sf_dir), 0.15).select("episode_index")


@query("SELECT episode_index, CASE WHEN episode_index % 4 < 2 THEN episode_index % 4 + 10 ELSE 99 END AS dst_chunk, CASE WHEN episode_index % 4 < 2 THEN 5 ELSE 7 END AS dst_file FROM ep")
def c12_file_map(spark, sf_dir):
    rows = episodes(spark, sf_dir).select("episode_index", (F.col("episode_index") % 4).alias("src_chunk"), F.lit(0).alias("src_file"))
    known = rows.where("src_chunk < 2").select("src_chunk", "src_file").distinct().withColumn("dst_chunk", F.col("src_chunk") + 10).withColumn("dst_file", F.lit(5))
    return E.map_files(rows, known, (99, 7)).select("episode_index", "dst_chunk", "dst_file")


@query("SELECT ep.episode_index, CASE WHEN ep.episode_index % 5 = 0 THEN 'stats' ELSE '' END AS missing FROM ep")
def c14_metadata_assembly(spark, sf_dir):
    e = episodes(spark, sf_dir).select("episode_index", "length")
    s = frames(spark, sf_dir).where("episode_index % 5 <> 0").groupBy("episode_index").agg(F.avg("s0").alias("mean"))
    return E.assemble_metadata({"episodes": e, "stats": s}).select("episode_index", F.array_join("missing", ",").alias("missing"))


@query("""
, o AS (SELECT o_custkey % 7 AS c, CASE WHEN o_orderdate < DATE '2100-01-01' THEN o_orderstatus END AS s, CAST(o_custkey % 1 AS VARCHAR) AS z FROM orders),
l AS (SELECT 'c' AS "column", CAST(c AS VARCHAR) AS v FROM o UNION ALL SELECT 's', s FROM o UNION ALL SELECT 'z', z FROM o)
SELECT "column", CASE WHEN COUNT(DISTINCT coalesce(v, 'null')) = 1 THEN MIN(coalesce(v, 'null')) END AS value, COUNT(DISTINCT coalesce(v, 'null')) = 1 AS agreed FROM l GROUP BY 1
""")
def d28_metadata_agreement(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("c"), F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 1).cast("string").alias("z"))
    return E.agreement(meta, ["c", "s", "z"], "c")


@query("SELECT task, task_index FROM tk UNION ALL SELECT o_orderstatus, 4 + ROW_NUMBER() OVER (ORDER BY o_orderstatus) FROM (SELECT DISTINCT o_orderstatus FROM orders) x")
def d29_tasks_in_order(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("task")).distinct()
    return E.merge_tasks([tasks(spark, sf_dir), status.withColumn("task_index", F.row_number().over(Window.orderBy("task")))])
