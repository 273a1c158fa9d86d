"""Queries over progress, stages and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.operators import progress as P
from trajframe.plans.registry import query
from trajframe.plans.views import frames, table

KEYS = ("episode_index", "frame_index")


def _intervals(spark, sf_dir):
    """Turns of conversations as stages: six frames each, with a gap of one."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("episode_index"), F.col("turn").alias("pos"), (F.col("turn") * 6 + 3).alias("start"), (F.col("turn") * 6 + 7).alias("end"), F.col("role").alias("name"))


_IV = ", iv AS (SELECT conv_id AS episode_index, turn AS pos, turn * 6 + 3 AS a, turn * 6 + 7 AS b, role AS name FROM conversations), nv AS (SELECT episode_index, COUNT(*) AS n FROM iv GROUP BY 1)"


@query(_IV + """
SELECT f.episode_index, f.frame_index, ROUND(CASE
  WHEN f.frame_index < 3 THEN 0.0
  WHEN f.frame_index > (nv.n - 1) * 6 + 7 THEN nv.n - 1 + 0.999
  WHEN (f.frame_index - 3) % 6 = 5 THEN (f.frame_index - 3) // 6 + 1.0
  ELSE (f.frame_index - 3) // 6 + least((f.frame_index - 3) % 6 / 4.0, CASE WHEN (f.frame_index - 3) // 6 = nv.n - 1 THEN 0.999 ELSE 1.0 END) END, 4) AS stage
FROM fr f JOIN nv ON nv.episode_index = f.episode_index
""")
def h8_stage_and_tau(spark, sf_dir):
    return P.stage_and_tau(frames(spark, sf_dir).select(*KEYS), _intervals(spark, sf_dir)).withColumn("stage", F.round("stage", 4))


@query("SELECT episode_index, frame_index, ROUND(least(greatest((frame_index - 5) / 20.0, 0), 1), 4)::DOUBLE AS tau FROM fr")
def h7_tau(spark, sf_dir):
    return frames(spark, sf_dir).select(*KEYS, F.round(P.tau(F.col("frame_index"), F.lit(5.0), F.lit(25.0)), 4).alias("tau"))


@query("""
, s AS (SELECT episode_index, frame_index, frame_index * 3.0::DOUBLE / length AS x FROM fr)
SELECT episode_index, frame_index, ROUND(CASE WHEN x < 1 THEN 0.2 * x WHEN x < 2 THEN 0.2 + 0.3 * (x - 1) ELSE 0.5 + 0.5 * (x - 2) END, 5) AS progress FROM s
""")
def h9_stage_to_progress(spark, sf_dir):
    stage = F.col("frame_index") * 3.0 / F.col("length")
    return frames(spark, sf_dir).select(*KEYS, F.round(P.to_progress(stage, [0.2, 0.3, 0.5]), 5).alias("progress"))


@query(_IV + """
, dv AS (SELECT episode_index, name, pos, 4.0::DOUBLE + (episode_index + 3 * pos) % 7 AS d FROM iv), l AS (SELECT episode_index, name, arg_max(d, pos) AS d FROM dv GROUP BY 1, 2), t AS (SELECT episode_index, SUM(d) AS total FROM dv GROUP BY 1),
p AS (SELECT name, AVG(d / total) AS p FROM l JOIN t USING (episode_index) GROUP BY 1)
SELECT name, ROUND(p / SUM(p) OVER (), 6) AS proportion FROM p
""")
def d11_temporal_proportions(spark, sf_dir):
    """Stages of different lengths, some names twice in an episode."""
    spans = _intervals(spark, sf_dir).withColumn("end", F.col("end") + (F.col("episode_index") + 3 * F.col("pos")) % 7)
    return P.proportions(spans).withColumn("proportion", F.round("proportion", 6))


_DELTA = """
, p AS (SELECT episode_index, frame_index, CASE WHEN task = 'error' THEN frame_index / length / 2 ELSE frame_index / length END AS p FROM fr),
d AS (SELECT episode_index, frame_index, coalesce(lead(p, 10) OVER (PARTITION BY episode_index ORDER BY frame_index), last_value(p) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - p AS delta FROM p),
m AS (SELECT greatest(AVG(delta), 0) AS m, greatest(STDDEV_POP(delta), 1e-6) AS s FROM d),
w AS (SELECT episode_index, frame_index, delta, CASE WHEN delta > 0.15 THEN 1.0 WHEN delta < 0 THEN 0.0 ELSE least(greatest((delta - (m - 2 * s)) / (4 * s + 1e-6), 0), 1) END AS weight FROM d, m)
"""


def _weighted(spark, sf_dir):
    done = F.col("frame_index") / F.col("length")
    rows = frames(spark, sf_dir).withColumn("p", F.when(F.col("task") == "error", done / 2).otherwise(done))
    return P.weigh(rows, "progress", progress="p", ahead=10, kappa=0.15)


@query(_DELTA + "SELECT episode_index, frame_index, ROUND(delta, 6) AS delta, ROUND(weight, 4)::DOUBLE AS weight FROM w")
def e17_progress_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select(*KEYS, F.round("delta", 6).alias("delta"), F.round("weight", 4).alias("weight"))


@query(_DELTA + "SELECT episode_index % 8 AS batch, COUNT(*) AS n, ROUND(SUM(weight) * COUNT(*) / (SUM(weight) + 1e-6), 3)::DOUBLE AS total, CAST(SUM(CASE WHEN weight = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM w GROUP BY 1")
def e18_batch_normalised_weights(spark, sf_dir):
    rows = P.batch_normalised(_weighted(spark, sf_dir).withColumn("batch", F.col("episode_index") % 8), "weight", "batch")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("scaled"), 3).alias("total"), F.count_if(F.col("weight") == 0).alias("n_zero"))


@query(_IV + """
, s AS (SELECT f.episode_index, f.frame_index, CASE WHEN f.frame_index < 3 THEN 0.0 WHEN f.frame_index > (nv.n - 1) * 6 + 7 THEN nv.n - 1 + 0.999 WHEN (f.frame_index - 3) % 6 = 5 THEN (f.frame_index - 3) // 6 + 1.0
  ELSE (f.frame_index - 3) // 6 + least((f.frame_index - 3) % 6 / 4.0, CASE WHEN (f.frame_index - 3) // 6 = nv.n - 1 THEN 0.999 ELSE 1.0 END) END AS stage FROM fr f JOIN nv ON nv.episode_index = f.episode_index)
SELECT episode_index, frame_index, ROUND(coalesce(lag(stage, 4) OVER w, first_value(stage) OVER w), 4) AS back, ROUND(stage, 4) AS now,
  ROUND(coalesce(lead(stage, 4) OVER w, last_value(stage) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 4) AS ahead FROM s WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)
""")
def e28_progress_targets(spark, sf_dir):
    """Stage + tau at each slot of a symmetric window."""
    from trajframe.operators.windows import delta_window

    staged = P.stage_and_tau(frames(spark, sf_dir).select(*KEYS), _intervals(spark, sf_dir))
    rows = delta_window(staged, "stage", [-4, 0, 4])
    return rows.select(*KEYS, *(F.round(F.get("stage_window", F.lit(i)), 4).alias(n) for i, n in enumerate(("back", "now", "ahead"))))


@query(_IV + """
, s AS (SELECT f.episode_index, f.frame_index, CASE WHEN f.frame_index < 3 THEN 0.0 WHEN f.frame_index > (nv.n - 1) * 6 + 7 THEN nv.n - 1 + 0.999 WHEN (f.frame_index - 3) % 6 = 5 THEN (f.frame_index - 3) // 6 + 1.0
  ELSE (f.frame_index - 3) // 6 + least((f.frame_index - 3) % 6 / 4.0, CASE WHEN (f.frame_index - 3) // 6 = nv.n - 1 THEN 0.999 ELSE 1.0 END) END AS stage FROM fr f JOIN nv ON nv.episode_index = f.episode_index)
SELECT f.episode_index, f.frame_index, u.used AS rewound, """ + ", ".join(
    f"ROUND((SELECT stage FROM s x WHERE x.episode_index = f.episode_index AND x.frame_index = greatest(0, least(f.length - 1, f.frame_index + {d}))), 4) AS t{i}" for i, d in enumerate((-4, -2, 0, 2, 4))
) + "".join(
    f", CASE WHEN u.used >= {k} THEN ROUND((SELECT stage FROM s x WHERE x.episode_index = f.episode_index AND x.frame_index = f.frame_index - {4 + 2 * k}), 4) ELSE 0 END AS t{4 + k}" for k in (1, 2, 3)
) + """ FROM fr f JOIN (SELECT episode_index, frame_index, CAST(CASE WHEN frame_index > 4 THEN least(frame_index % 4, 3, (frame_index - 4) // 2) ELSE 0 END AS INTEGER) AS used FROM fr) u
  ON u.episode_index = f.episode_index AND u.frame_index = f.frame_index""")
def e28_rewound_targets(spark, sf_dir):
    """Targets of five observed frames, two apart, and of up to three rewound ones; null in episodes without stages."""
    staged = P.stage_and_tau(frames(spark, sf_dir).select(*KEYS), _intervals(spark, sf_dir), how="left")
    found = P.progress_targets(staged, "stage", 4, 3, 2, F.col("frame_index") % 4)
    return found.select(*KEYS, "rewound", *(F.round(F.get("targets", F.lit(i)), 4).alias(f"t{i}") for i in range(8)))


@query(_IV + "SELECT iv.episode_index, CAST(pos AS INTEGER) AS pos, name, ROUND(a / 10.0, 2)::DOUBLE AS start FROM iv JOIN ep USING (episode_index)")
def h11_annotation_arrays(spark, sf_dir):
    """Annotations written to arrays on episodes and read back."""
    from trajframe.plans.views import episodes

    spans = _intervals(spark, sf_dir).withColumn("start", F.col("start") / 10.0).withColumn("end", F.col("end") / 10.0)
    known = episodes(spark, sf_dir).join(spans.select("episode_index").distinct(), "episode_index", "left_semi")
    back = P.read_annotations(P.annotate(known, spans, "dense", 10.0), "dense")
    return back.select("episode_index", "pos", "name", F.round("start", 2).alias("start"))
