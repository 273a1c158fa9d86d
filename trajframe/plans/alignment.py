"""Queries over series with their own clocks: views as states, clicks as actions, purchases as camera frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.operators import align
from trajframe.plans.registry import query
from trajframe.plans.views import events, frames, table


def series(spark, sf_dir, kind: str):
    return events(spark, sf_dir).where(F.col("task") == kind).select("episode_index", (F.col("us") / 1e6).alias("t"), "event_id", F.col("s0").alias(f"{kind}_value"))


_S = "{v} AS (SELECT episode_index, us / 1e6 AS t, event_id, s0 FROM ev WHERE task = '{k}')"
_SERIES = ", " + ", ".join(_S.format(v=v, k=k) for v, k in (("st", "view"), ("ac", "click"), ("ca", "purchase")))


def _out(rows, *cols):
    return rows.select("episode_index", "event_id", *(F.round(c, 4).alias(c) for c in cols))


@query(_SERIES + "SELECT st.episode_index, st.event_id, ROUND(ac.s0, 4) AS click_value FROM st ASOF LEFT JOIN ac ON st.episode_index = ac.episode_index AND st.t >= ac.t")
def c6_asof_backward(spark, sf_dir):
    return _out(align.asof(series(spark, sf_dir, "view"), series(spark, sf_dir, "click"), "episode_index", "t", ["click_value"]), "click_value")


@query(_SERIES + """, f AS (SELECT episode_index, arg_min(s0, t) AS s0 FROM ac GROUP BY 1)
SELECT st.episode_index, st.event_id, ROUND(coalesce(ac.s0, f.s0), 4) AS click_value FROM st ASOF LEFT JOIN ac ON st.episode_index = ac.episode_index AND st.t >= ac.t LEFT JOIN f ON f.episode_index = st.episode_index""")
def c6_asof_backward_clipped(spark, sf_dir):
    return _out(align.asof(series(spark, sf_dir, "view"), series(spark, sf_dir, "click"), "episode_index", "t", ["click_value"], clip=True), "click_value")


_PREV_NEXT = _SERIES + """
, b AS (SELECT st.episode_index, st.event_id, st.t, ac.t AS bt, ac.s0 AS bv FROM st ASOF LEFT JOIN ac ON st.episode_index = ac.episode_index AND st.t >= ac.t),
n AS (SELECT b.*, ac.t AS nt, ac.s0 AS av FROM b ASOF LEFT JOIN ac ON b.episode_index = ac.episode_index AND b.t <= ac.t)
"""


@query(_PREV_NEXT + "SELECT episode_index, event_id, ROUND(CASE WHEN bt IS NULL THEN av WHEN nt IS NULL OR nt = bt THEN bv ELSE bv + (av - bv) * (t - bt) / (nt - bt) END, 4) AS click_value FROM n")
def c7_interpolate(spark, sf_dir):
    return _out(align.interpolate(series(spark, sf_dir, "view"), series(spark, sf_dir, "click"), "episode_index", "t", ["click_value"]), "click_value")


@query(_PREV_NEXT + """SELECT episode_index, event_id, ROUND(CASE WHEN bt IS NULL OR nt - t < t - bt THEN coalesce(av, bv) ELSE bv END, 4) AS click_value,
  abs(CASE WHEN bt IS NULL OR nt - t < t - bt THEN coalesce(nt, bt) ELSE bt END - t) < 7200 AS within_tol FROM n""")
def c8_nearest_with_tolerance(spark, sf_dir):
    rows = align.asof(series(spark, sf_dir, "view"), series(spark, sf_dir, "click"), "episode_index", "t", ["click_value"], "nearest", 7200.0)
    return rows.select("episode_index", "event_id", F.round("click_value", 4).alias("click_value"), "within_tol")


@query(_PREV_NEXT + """SELECT n.episode_index, event_id, ROUND(coalesce(bv, f.v), 4) AS held, ROUND(CASE WHEN bt IS NULL OR nt - t < t - bt THEN coalesce(av, bv) ELSE bv END, 4) AS near,
  ROUND(coalesce(av, l.v), 4) AS coming, ROUND(CASE WHEN bt IS NULL THEN av WHEN nt IS NULL OR nt = bt THEN bv ELSE bv + (av - bv) * (t - bt) / (nt - bt) END, 4) AS between
  FROM n LEFT JOIN (SELECT episode_index, arg_min(s0, t) AS v FROM ac GROUP BY 1) f ON f.episode_index = n.episode_index
  LEFT JOIN (SELECT episode_index, arg_max(s0, t) AS v FROM ac GROUP BY 1) l ON l.episode_index = n.episode_index""")
def c6_long_episodes(spark, sf_dir):
    """All four alignments with episodes dealt by ranges of time."""
    rows, right = series(spark, sf_dir, "view"), series(spark, sf_dir, "click")
    ways = {"held": ("backward", True), "near": ("nearest", False), "coming": ("forward", True)}
    rows = align.asof_each(rows, right, "episode_index", "t", "click_value", ways, long_keys=True)
    rows = align.interpolate(rows, right, "episode_index", "t", ["click_value"], long_keys=True).withColumnRenamed("click_value", "between")
    return _out(rows, "held", "near", "coming", "between")


@query(_PREV_NEXT + "SELECT n.episode_index, event_id, ROUND(coalesce(av, l.v), 4) AS click_value FROM n LEFT JOIN (SELECT episode_index, arg_max(s0, t) AS v FROM ac GROUP BY 1) l ON l.episode_index = n.episode_index")
def c9_asof_forward_clipped(spark, sf_dir):
    return _out(align.asof(series(spark, sf_dir, "view"), series(spark, sf_dir, "click"), "episode_index", "t", ["click_value"], "forward", clip=True), "click_value")


@query(_SERIES + """
, lim AS (SELECT episode_index, MAX(lo) AS lo, MIN(hi) AS hi FROM (
    SELECT episode_index, MIN(t) AS lo, MAX(t) AS hi FROM st GROUP BY 1 UNION ALL SELECT episode_index, MIN(t), MAX(t) FROM ac GROUP BY 1 UNION ALL SELECT episode_index, MIN(t), MAX(t) FROM ca GROUP BY 1) x
  GROUP BY 1 HAVING COUNT(*) = 3 AND MIN(hi) > MAX(lo)),
g AS (SELECT episode_index, unnest(range(0, CAST(ceil((hi - lo) * (1.0::DOUBLE / 14400)) AS BIGINT))) AS step, lo FROM lim),
p AS (SELECT episode_index, step, lo + step / (1.0::DOUBLE / 14400) AS t FROM g),
a AS (SELECT p.*, st.t AS bt, st.s0 AS bv FROM p ASOF LEFT JOIN st ON p.episode_index = st.episode_index AND p.t >= st.t),
b AS (SELECT a.*, st.t AS nt, st.s0 AS nv FROM a ASOF LEFT JOIN st ON a.episode_index = st.episode_index AND a.t <= st.t),
c AS (SELECT b.*, ac.s0 AS act FROM b ASOF LEFT JOIN ac ON b.episode_index = ac.episode_index AND b.t >= ac.t),
d AS (SELECT c.*, ca.event_id AS cam FROM c ASOF LEFT JOIN ca ON c.episode_index = ca.episode_index AND c.t <= ca.t)
SELECT episode_index, step, ROUND(CASE WHEN nt = bt THEN bv ELSE bv + (nv - bv) * (t - bt) / (nt - bt) END, 3) AS view_value, ROUND(act, 4) AS click_value, cam AS camera_frame FROM d
""")
def c10_time_sync(spark, sf_dir):
    camera = series(spark, sf_dir, "purchase").select("episode_index", "t", F.col("event_id").alias("camera_frame"))
    states = series(spark, sf_dir, "view").drop("event_id")
    actions = series(spark, sf_dir, "click").drop("event_id")
    grid = align.time_sync(states, actions, camera, "episode_index", "t", ["view_value"], ["click_value"], "camera_frame", 1.0 / 14400)
    return grid.select("episode_index", "step", F.round("view_value", 3).alias("view_value"), F.round("click_value", 4).alias("click_value"), "camera_frame")


@query("""
, iv AS (SELECT conv_id AS episode_index, turn AS pos, turn * 6 AS a, turn * 6 + 4 AS b, role FROM conversations)
SELECT f.episode_index, f.frame_index, iv.role, iv.pos FROM fr f LEFT JOIN iv ON iv.episode_index = f.episode_index AND f.frame_index BETWEEN iv.a AND iv.b
""")
def c5_interval_join(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    spans = conv.select(F.col("conv_id").alias("episode_index"), F.col("turn").alias("pos"), (F.col("turn") * 6).alias("a"), (F.col("turn") * 6 + 4).alias("b"), "role")
    return align.interval_join(frames(spark, sf_dir).select("episode_index", "frame_index"), spans, "episode_index", "frame_index", "a", "b", "pos").select("episode_index", "frame_index", "role", "pos")
