"""Queries over windows and sequences inside episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.operators import windows as W
from trajframe.plans.registry import query
from trajframe.plans.views import frames

KEYS = ("episode_index", "frame_index")


@query("""
, d AS (SELECT f.*, k.d FROM fr f, (VALUES (-5), (0), (3)) k(d))
SELECT d.episode_index, d.frame_index, CAST(d.d AS INTEGER) AS delta, ROUND(g.s0, 4) AS value, d.frame_index + d.d < 0 OR d.frame_index + d.d >= d.length AS is_pad
FROM d JOIN fr g ON g.episode_index = d.episode_index AND g.frame_index = least(greatest(d.frame_index + d.d, 0), d.length - 1)
""")
def e1_delta_window_clamped(spark, sf_dir):
    deltas = [-5, 0, 3]
    rows = W.delta_window(frames(spark, sf_dir), "s0", deltas)
    cells = F.array(*(F.struct(F.lit(d).alias("delta"), F.round(F.get("s0_window", F.lit(i)), 4).alias("value"), F.get("s0_window_is_pad", F.lit(i)).alias("is_pad")) for i, d in enumerate(deltas)))
    return rows.select(*KEYS, F.inline(cells))


@query("""
, d AS (SELECT f.*, k.d FROM fr f, (VALUES (-40), (-1), (40)) k(d))
SELECT d.episode_index, d.frame_index, CAST(d.d AS BIGINT) AS delta, ROUND(g.s0, 4) AS value, d.frame_index + d.d < 0 OR d.frame_index + d.d >= d.length AS is_pad
FROM d JOIN fr g ON g.episode_index = d.episode_index AND g.frame_index = least(greatest(d.frame_index + d.d, 0), d.length - 1)
""")
def e1_delta_window_by_join(spark, sf_dir):
    return W.delta_window_by_join(frames(spark, sf_dir), "s0", [-40, -1, 40]).withColumn("value", F.round("value", 4))


@query("""
, c AS (SELECT episode_index, frame_index, LIST(s0) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM fr)
SELECT episode_index, frame_index, ROUND(list_sum(v), 4) AS total, ROUND(v[8], 4) AS last_value FROM c WHERE len(v) = 8
""")
def e3_action_chunks(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("action", F.array("s0"))
    flat = F.transform("chunk", lambda a: F.get(a, F.lit(0)))
    chunks = W.action_chunks(rows, "action", 8).select(*KEYS, flat.alias("v"))
    return chunks.select(*KEYS, F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"), F.round(F.get("v", F.lit(7)), 4).alias("last_value"))


@query("""
SELECT a.episode_index, a.frame_index,
  ROUND(CASE WHEN a.frame_index >= 5 THEN lag(a.s0, 5) OVER w WHEN a.frame_index >= 1 THEN lag(a.s0, 1) OVER w ELSE a.s0 END, 4) AS back5,
  ROUND(CASE WHEN a.frame_index + 9 < a.length THEN lead(a.s0, 9) OVER w WHEN a.frame_index + 2 < a.length THEN lead(a.s0, 2) OVER w ELSE a.s0 END, 4) AS ahead9
FROM fr a WINDOW w AS (PARTITION BY a.episode_index ORDER BY a.frame_index)
""")
def e4_delta_window_nearest_success(spark, sf_dir):
    rows = W.delta_window(frames(spark, sf_dir), "s0", [-1, -5, 2, 9], "nearest_success")
    return rows.select(*KEYS, F.round(F.get("s0_window", F.lit(1)), 4).alias("back5"), F.round(F.get("s0_window", F.lit(3)), 4).alias("ahead9"))


@query("""
, d AS (SELECT f.episode_index, f.frame_index, f.length, k.d FROM fr f, (VALUES (-6), (-3), (0), (3), (6)) k(d))
SELECT episode_index, frame_index, CAST(SUM(CASE WHEN frame_index + d < 0 OR frame_index + d >= length THEN 1 ELSE 0 END) AS BIGINT) AS n_out FROM d GROUP BY ALL
""")
def e5_symmetric_window(spark, sf_dir):
    rows = W.delta_window(frames(spark, sf_dir), "s0", W.symmetric_deltas(4, 3))
    return rows.select(*KEYS, F.size(F.filter("s0_window_is_pad", lambda p: p)).cast("long").alias("n_out"))


@query("""
SELECT f.episode_index, f.frame_index, CAST(k.k AS INTEGER) AS step, f.frame_index - k.k * 5 AS at
FROM fr f JOIN range(1, 5) k(k) ON k.k <= least(f.frame_index // 5, 4)
""")
def e6_rewind(spark, sf_dir):
    return W.rewind(frames(spark, sf_dir), 4, 5)


_GRADIENT = """
, h AS (SELECT episode_index, frame_index, s0 AS y, t, lag(s0) OVER w AS y0, lag(t) OVER w AS t0, lead(s0) OVER w AS y1, lead(t) OVER w AS t1,
               lead(s0, 2) OVER w AS y2, lead(t, 2) OVER w AS t2, lag(s0, 2) OVER w AS z2, lag(t, 2) OVER w AS u2 FROM fr WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, frame_index, ROUND(1000 * CASE
  WHEN t0 IS NULL THEN -(2 * (t1 - t) + (t2 - t1)) / ((t1 - t) * (t2 - t)) * y + (t2 - t) / ((t1 - t) * (t2 - t1)) * y1 - (t1 - t) / ((t2 - t1) * (t2 - t)) * y2
  WHEN t1 IS NULL THEN (2 * (t - t0) + (t0 - u2)) / ((t - t0) * (t - u2)) * y - (t - u2) / ((t - t0) * (t0 - u2)) * y0 + (t - t0) / ((t0 - u2) * (t - u2)) * z2
  ELSE (y1 * (t - t0) * (t - t0) + y * ((t1 - t) * (t1 - t) - (t - t0) * (t - t0)) - y0 * (t1 - t) * (t1 - t)) / ((t - t0) * (t1 - t) * (t1 - t0)) END, 5) AS slope FROM h
"""


@query(_GRADIENT)
def e7_gradient(spark, sf_dir):
    return frames(spark, sf_dir).select(*KEYS, F.round(1000 * W.gradient(F.col("s0"), F.col("t")), 5).alias("slope"))


@query(_GRADIENT)
def e7_gradient_in_pieces(spark, sf_dir):
    """The same with episodes cut into pieces that borrow their neighbours' ends."""
    return W.with_gradient(frames(spark, sf_dir), F.col("s0"), F.col("t"), "g", 32).select(*KEYS, F.round(F.col("g") * 1000, 5).alias("slope"))



@query("""
, a AS (SELECT episode_index, frame_index, s1 / 20 AS x, s1 / 20 - lag(s1 / 20) OVER (PARTITION BY episode_index ORDER BY frame_index) AS d FROM fr)
SELECT episode_index, frame_index, ROUND(x + coalesce(SUM(-2 * pi() * round(d / (2 * pi()))) OVER (PARTITION BY episode_index ORDER BY frame_index), 0), 4) AS angle FROM a
""")
def e8_unwrap(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("x", F.col("s1") / 20)
    return W.unwrap(rows, "x", "angle", 32).select(*KEYS, F.round("angle", 4).alias("angle"))


@query("""
, d AS (SELECT episode_index, sqrt(pow(s0 - lag(s0) OVER w, 2) + pow(s1 - lag(s1) OVER w, 2)) AS d, (s0 + lag(s0) OVER w) / 2 * (t - lag(t) OVER w) / 3600 AS a FROM fr WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, ROUND(coalesce(SUM(d), 0), 4) AS path_length, ROUND(coalesce(SUM(a), 0), 2) AS integral FROM d GROUP BY 1
""")
def e9_path_length_and_integral(spark, sf_dir):
    rows = frames(spark, sf_dir)
    both = W.path_length(rows, ["s0", "s1"], 32).join(W.trapezoid(rows, F.col("s0"), F.col("t") / 3600, 32), "episode_index")
    return both.select("episode_index", F.round("path_length", 4).alias("path_length"), F.round("integral", 2).alias("integral"))


@query("""
, r AS (SELECT episode_index, length, p.p, p.p * (length - 1) / 9.0::DOUBLE AS x FROM ep, range(0, 10) p(p))
SELECT r.episode_index, CAST(r.p AS INTEGER) AS point, ROUND(a.s0 + (b.s0 - a.s0) * (x - floor(x)), 4) AS s0
FROM r JOIN fr a ON a.episode_index = r.episode_index AND a.frame_index = floor(x) JOIN fr b ON b.episode_index = r.episode_index AND b.frame_index = least(floor(x) + 1, r.length - 1)
""")
def e12_resample(spark, sf_dir):
    from trajframe.operators.evaluate import resample

    return resample(frames(spark, sf_dir), ["s0"], 10).withColumn("s0", F.round("s0", 4))


@query("""
SELECT episode_index, frame_index, ROUND(CASE WHEN task = 'purchase' OR lead(s0) OVER w IS NULL THEN s0 ELSE lead(s0) OVER w END, 4) AS next_s0,
       task = 'purchase' OR lead(s0) OVER w IS NULL AS done
FROM fr WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)
""")
def e13_transitions(spark, sf_dir):
    rows = frames(spark, sf_dir)
    last = F.lead("frame_index").over(W.in_order()).isNull()
    return W.transitions(rows, ["s0"], (F.col("task") == "purchase") | last).select(*KEYS, F.round("next_s0", 4).alias("next_s0"), "done")


@query("SELECT episode_index, frame_index, ROUND(coalesce((s0 - lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index)) / 0.1::DOUBLE, 0), 3) AS vel_s0 FROM fr")
def e14_velocity(spark, sf_dir):
    return W.velocity(frames(spark, sf_dir), ["s0"], 0.1, 32).select(*KEYS, F.round("vel_s0", 3).alias("vel_s0"))


@query("SELECT episode_index, frame_index, CAST(coalesce(SUM(CASE WHEN task = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM fr")
def e15_segments(spark, sf_dir):
    return W.segments(frames(spark, sf_dir), "episode_index", ["frame_index"], F.col("task") == "purchase").select(*KEYS, "segment")


@query("SELECT episode_index, frame_index, frame_index + 1 >= 40 AS truncated FROM fr")
def e16_step_limit(spark, sf_dir):
    return frames(spark, sf_dir).select(*KEYS, (F.row_number().over(W.in_order()) >= 40).alias("truncated"))


@query("""
, p AS (SELECT episode_index, frame_index, s0, lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index) AS b FROM fr)
SELECT episode_index, frame_index, CAST(k.k AS INTEGER) AS sub, ROUND(CASE WHEN b IS NULL THEN s0 ELSE b + (s0 - b) * k.k / 3 END, 4) AS value FROM p JOIN range(1, 4) k(k) ON b IS NOT NULL OR k.k = 1
""")
def e19_upsample(spark, sf_dir):
    return W.upsample(frames(spark, sf_dir), "s0", 3).withColumn("value", F.round("value", 4))


def _chunks(spark, sf_dir, every: int, horizon: int):
    """Every chunk predicts its own values for a step: the true one, off by a number that goes with the chunk's start."""
    rows = frames(spark, sf_dir).withColumn("a", F.collect_list("s0").over(W.in_order().rowsBetween(0, horizon - 1)))
    rows = rows.withColumn("a", F.transform("a", lambda x: x + F.col("frame_index") % 11 * 0.5))
    return rows.where((F.col("frame_index") % every == 0) & (F.size("a") == horizon)).select("episode_index", F.col("frame_index").alias("start_step"), F.col("event_id").alias("arrival"), F.col("a").alias("actions"))


_CHUNKS = """
, c AS (SELECT f.episode_index, f.frame_index AS start_step, f.event_id AS arrival, k.k, f.frame_index + k.k AS target, g.s0 + f.frame_index % 11 * 0.5::DOUBLE AS a
        FROM fr f JOIN range(0, 8) k(k) ON TRUE JOIN fr g ON g.episode_index = f.episode_index AND g.frame_index = f.frame_index + k.k WHERE f.frame_index % 3 = 0 AND f.frame_index + 8 <= f.length)
"""


@query(_CHUNKS + """
, w AS (SELECT *, exp(-0.01 * (row_number() OVER (PARTITION BY episode_index, target ORDER BY start_step) - 1)) AS w FROM c)
SELECT episode_index, target, ROUND(SUM(w * a) / SUM(w), 4) AS value, COUNT(*) AS n FROM w GROUP BY 1, 2
""")
def e20_temporal_ensemble(spark, sf_dir):
    return W.temporal_ensemble(_chunks(spark, sf_dir, 3, 8), 0.01).withColumn("value", F.round("value", 4))


@query(_CHUNKS + """
, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY episode_index, target ORDER BY arrival) AS r, COUNT(*) OVER (PARTITION BY episode_index, target) AS m FROM c WHERE target > 10)
SELECT episode_index, target, ROUND(SUM(a * pow(0.5, CASE WHEN r = 1 THEN m - 1 ELSE m - r + 1 END)), 4) AS value, COUNT(*) AS n FROM o GROUP BY 1, 2
""")
def e21_overlap_merge(spark, sf_dir):
    return W.merge_overlaps(_chunks(spark, sf_dir, 3, 8), "average", F.lit(10)).withColumn("value", F.round("value", 4))


@query(_CHUNKS + "SELECT episode_index, target, ROUND(arg_max(a, start_step), 4) AS value, MAX(start_step) AS chunk FROM c WHERE k >= 2 GROUP BY 1, 2")
def e22_delay_aware_replace(spark, sf_dir):
    return W.replace_late(_chunks(spark, sf_dir, 3, 8), 2).withColumn("value", F.round("value", 4))


@query("""
, m AS (SELECT episode_index, frame_index, s0, task IN ('click', 'view') AS en FROM fr),
e AS (SELECT *, en AND NOT coalesce(lag(en) OVER (PARTITION BY episode_index ORDER BY frame_index), FALSE) AS edge FROM m)
SELECT episode_index, frame_index, ROUND(last_value(CASE WHEN edge THEN s0 END IGNORE NULLS) OVER w, 4) AS reference, ROUND(last_value(CASE WHEN en THEN s0 END IGNORE NULLS) OVER w, 4) AS command
FROM e WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def e23_latch(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("en", F.col("task").isin("click", "view"))
    return W.latch(rows, "en", "s0").select(*KEYS, F.round("reference", 4).alias("reference"), F.round("command", 4).alias("command"))


@query("""
, c AS (SELECT episode_index, frame_index, least(greatest(s0, 5), 60) AS x FROM fr)
SELECT episode_index, frame_index, ROUND(x, 4) AS clipped, coalesce(abs(x - lag(x) OVER (PARTITION BY episode_index ORDER BY frame_index)) > 30, FALSE) AS jump FROM c
""")
def e24_clip_and_jump(spark, sf_dir):
    return W.clip_and_flag(frames(spark, sf_dir), "s0", 5.0, 60.0, 30.0).select(*KEYS, F.round("clipped", 4).alias("clipped"), "jump")


@query("""
, m AS (SELECT episode_index, frame_index, task = 'view' AS f, frame_index - row_number() OVER (PARTITION BY episode_index, task = 'view' ORDER BY frame_index) AS g FROM fr)
SELECT episode_index, MIN(frame_index) AS first_frame, MAX(frame_index) AS last_frame, COUNT(*) AS n FROM m WHERE f GROUP BY episode_index, g
""")
def e25_islands(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("f", F.col("task") == "view")
    return W.islands(rows, "f").select("episode_index", "first_frame", "last_frame", "n")


@query("""
, m AS (SELECT *, CASE WHEN task = 'signup' THEN 1 ELSE 0 END AS e FROM fr), n AS (SELECT *, SUM(e) OVER (PARTITION BY episode_index ORDER BY frame_index) AS n FROM m),
o AS (SELECT episode_index, t AS t0 FROM n WHERE e = 1 AND n % 2 = 1)
SELECT episode_index, frame_index FROM n WHERE n % 2 = 1 OR (e = 1 AND n % 2 = 0)
UNION SELECT n.episode_index, n.frame_index FROM n JOIN o ON o.episode_index = n.episode_index AND n.t <= o.t0 AND o.t0 - n.t <= 86400
""")
def e26_pre_roll(spark, sf_dir):
    return W.pre_roll(frames(spark, sf_dir), F.col("task") == "signup", "t", 86400.0).select(*KEYS)


@query("SELECT episode_index, frame_index FROM fr WHERE frame_index % 7 = 0 OR frame_index = length - 1")
def e27_stride(spark, sf_dir):
    return W.strided(frames(spark, sf_dir), 7).select(*KEYS)


@query("""
, kept AS (
  SELECT episode_index, frame_index FROM fr WHERE frame_index = 0
  UNION ALL
  SELECT k.episode_index, MIN(f.frame_index) FROM kept k JOIN fr c ON c.episode_index = k.episode_index AND c.frame_index = k.frame_index
  JOIN fr f ON f.episode_index = k.episode_index AND f.frame_index > k.frame_index AND sqrt(pow(f.s0 - c.s0, 2) + pow(f.s1 - c.s1, 2)) >= 20 GROUP BY k.episode_index)
SELECT episode_index, frame_index FROM kept
""")
def e29_near_duplicate_runs(spark, sf_dir):
    return W.drop_near_duplicates(frames(spark, sf_dir), ["s0", "s1"], 20.0)


@query("SELECT episode_index, frame_index, CAST(floor((t - first_value(t) OVER (PARTITION BY episode_index ORDER BY frame_index)) / 259200) AS BIGINT) AS part FROM fr")
def e30_timed_rotation(spark, sf_dir):
    return W.rotate(frames(spark, sf_dir), F.col("t"), 259200.0).select(*KEYS, "part")


@query("SELECT arg_max(event_id, idx) AS event_id, MAX(idx) AS idx FROM fr")
def f6_newest(spark, sf_dir):
    from trajframe.operators.sampling import newest

    return newest(frames(spark, sf_dir).select("event_id", "idx"), ["idx"], 1)
