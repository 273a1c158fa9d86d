"""Queries over projections, dictionary joins and ingest."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trajframe.functions import vectors as V
from trajframe.operators import stats as S
from trajframe.plans.registry import query
from trajframe.plans.views import frames, half_of, table, tasks
from trajframe.sources import dataset as D


@query("SELECT episode_index, frame_index, ROUND(s0, 4) AS state_a, ROUND(s1, 4) AS state_b FROM fr")
def b5_rename_columns(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumnsRenamed({"s0": "state_a", "s1": "state_b", "not_there": "x"})
    return rows.select("episode_index", "frame_index", F.round("state_a", 4).alias("state_a"), F.round("state_b", 4).alias("state_b"))


@query("SELECT idx, ROUND(s0, 4) AS s0, ROUND(s1, 4) AS s1 FROM fr")
def b10_pattern_selection(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.select("idx", *(F.round(c, 4).alias(c) for c in rows.columns if re.search(r"^s[0-9]$", c)))


@query("SELECT idx, CAST(2 AS INTEGER) AS dims, ROUND(CAST(s0 AS FLOAT)::DOUBLE, 4) AS first FROM fr")
def b11_assemble_vector(spark, sf_dir):
    rows = frames(spark, sf_dir).select("idx", V.assemble(["s0", "s1"]).alias("v"))
    return rows.select("idx", F.size("v").alias("dims"), F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"))


@query("SELECT f.idx, n.n_name AS subtask FROM fr f LEFT JOIN nation n ON n.n_nationkey = f.frame_index")
def c2_subtask_left_join(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("frame_index"), F.col("n_name").alias("subtask"))
    return frames(spark, sf_dir).join(names, "frame_index", "left").select("idx", "subtask")


@query("SELECT fr.idx, 4 - tk.task_index AS new_task_index FROM fr JOIN tk USING (task)")
def c11_task_remapping(spark, sf_dir):
    """Old index to name to new index, the new dictionary being in reverse order."""
    old = tasks(spark, sf_dir)
    new = old.select("task", (F.lit(4).cast("long") - F.col("task_index")).alias("new_task_index"))
    mapping = old.join(new, "task").select("task_index", "new_task_index")
    return frames(spark, sf_dir).join(F.broadcast(mapping), "task_index").select("idx", "new_task_index")


@query(", h AS (SELECT (MAX(episode_index) + 1) // 2 AS h FROM ep) SELECT CAST(CASE WHEN episode_index < h THEN 1 ELSE 2 END AS INTEGER) AS part, COUNT(*) AS n, ROUND(SUM(s0), 2) AS total FROM fr, h GROUP BY 1")
def g7_transition_concat(spark, sf_dir):
    rows, half = frames(spark, sf_dir).select("episode_index", "s0"), half_of(spark, sf_dir)
    a = rows.where(F.col("episode_index") < half).withColumn("part", F.lit(1))
    b = rows.where(F.col("episode_index") >= half).withColumn("part", F.lit(2)).select("part", "s0", "episode_index")
    return a.unionByName(b).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s0"), 2).alias("total"))


@query("SELECT conv_id, turn AS frame_index, role, length(text) AS n FROM conversations")
def a14_flatten_nested_episodes(spark, sf_dir):
    """Conversations nested to one row each and flattened to frames again."""
    conv = table(spark, sf_dir, "conversations")
    nested = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("n")))).alias("steps"))
    return D.flatten_episodes(nested).select("conv_id", "frame_index", "role", "n")


@query("""
, a AS (SELECT episode_index, s0, ROW_NUMBER() OVER (PARTITION BY episode_index ORDER BY us) - 1 AS k FROM ev WHERE task = 'view'),
b AS (SELECT episode_index, s0, ROW_NUMBER() OVER (PARTITION BY episode_index ORDER BY us) - 1 AS k FROM ev WHERE task = 'click')
SELECT a.episode_index, a.k AS frame_index, ROUND(a.s0, 4) AS state, ROUND(b.s0, 4) AS action FROM a JOIN b ON a.episode_index = b.episode_index AND a.k = b.k
""")
def a13_pair_streams(spark, sf_dir):
    rows = frames(spark, sf_dir)
    side = lambda kind, name: rows.where(F.col("task") == kind).select(F.col("episode_index").alias("episode"), F.col("us").alias("timestamp"), F.col("s0").alias(name))
    paired = D.pair_streams(side("view", "state"), side("click", "action"))
    return paired.select(F.col("episode").alias("episode_index"), "frame_index", F.round("state", 4).alias("state"), F.round("action", 4).alias("action"))


@query("""
, l AS (SELECT 's0' AS feature, s0 AS v FROM fr UNION ALL SELECT 's1', s1 FROM fr)
SELECT feature, COUNT(*) AS count, ROUND(MIN(v), 4) AS min, ROUND(MAX(v), 4) AS max, ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_POP(v), 4) AS std FROM l GROUP BY 1
""")
def a6_stats_json(spark, sf_dir):
    """Stats written as JSON, and read from it."""
    text = S.as_json(S.merge_stats(S.per_episode_stats(frames(spark, sf_dir), ["s0", "s1"])))
    back = text.select("feature", F.from_json("json", "count long, min double, max double, mean double, std double").alias("j"))
    return back.select("feature", "j.count", *(F.round(f"j.{c}", 4).alias(c) for c in ("min", "max", "mean", "std")))


@query()
def a18_file_report(spark, sf_dir):
    return D.file_report(table(spark, sf_dir, "events"))


@query("""
SELECT 'embedding' AS "column", 'wrong length' AS problem, COUNT(*) AS n FROM embeddings WHERE label IN (3, 5) HAVING COUNT(*) > 0
UNION ALL SELECT 'task', 'null value', COUNT(*) FROM embeddings WHERE label = 7 HAVING COUNT(*) > 0
UNION ALL SELECT 'label', 'extra column', 1 UNION ALL SELECT 'state', 'missing column', 1
""")
def b17_frame_violations(spark, sf_dir):
    """Vectors of one label are cut short, those of another are null, a third has no task; a column is missing, another is too much."""
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 60)).when(F.col("label") != 5, F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select(cut.alias("embedding"), F.when(F.col("label") != 7, F.lit("t")).alias("task"), "label")
    return D.frame_violations(rows, {"embedding": {"dtype": "float32", "shape": [64]}, "task": {"dtype": "string", "shape": [1]}, "state": {"dtype": "float32", "shape": [1]}})
