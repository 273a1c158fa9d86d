"""Streaming queries: events arrive as a file per month, results are read back; the SQL is that of the batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.plans.registry import query
from trajframe.plans.views import frames
from trajframe.streaming import operators as S
from trajframe.streaming import stateful as T
from trajframe.streaming.storage import new_folder


PART_DAYS = 45
DAY_MS = 86_400_000
#: Episodes end by silence, as no row is marked as their last; parts may come in each other's triggers, so the watermark waits for two.
SILENT = {"time": "ts", "silence_ms": 1000 * DAY_MS, "delay": f"{2 * PART_DAYS} days"}


def _arriving(spark, sf_dir):
    """Frames with the part of the time in which they arrive (a few parts, whatever the size)."""
    rows = frames(spark, sf_dir).withColumn("is_last", F.col("frame_index") == F.col("length") - 1)
    span = F.floor(F.col("us") / F.lit(PART_DAYS * DAY_MS * 1000))
    return rows.select("episode_index", "frame_index", "event_id", "t", "s0", "s1", "task", "is_last", F.timestamp_micros("us").alias("ts"), span.alias("part"))


def _run(spark, sf_dir, transform, mode="append"):
    return S.replay(spark, _arriving(spark, sf_dir), "part", transform, new_folder(spark), mode)


def _run_silent(spark, sf_dir, transform):
    """The frames without end marks, and at last a row of another source, years on, that shows that time has passed."""
    T.use_state_store(spark)
    rows = _arriving(spark, sf_dir).withColumn("is_last", F.lit(False))
    last = rows.agg(F.max(F.struct("part", "ts")).alias("m"))
    beat = last.select(F.lit(-1).cast("long").alias("episode_index"), F.lit(0).cast("long").alias("frame_index"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("t"), F.lit(0.0).alias("s0"), F.lit(0.0).alias("s1"), F.lit("").alias("task"), F.lit(False).alias("is_last"), (F.col("m.ts") + F.expr("INTERVAL 2000 DAYS")).alias("ts"), (F.col("m.part") + 1).alias("part"))
    return S.replay(spark, rows.unionByName(beat), "part", transform, new_folder(spark)).where("episode_index >= 0")


@query("SELECT episode_index, COUNT(*) AS n, ROUND(SUM(s0), 2) AS total FROM fr GROUP BY 1")
def i1_streaming_scan(spark, sf_dir):
    rows = _run(spark, sf_dir, lambda s: s.select("episode_index", "s0"))
    return rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s0"), 2).alias("total"))


@query("""
SELECT a.episode_index, a.frame_index, ROUND(b.s0, 4) AS back_value, ROUND(c.s0, 4) AS ahead_value, a.frame_index < 3 AS back_pad, a.frame_index + 2 >= a.length AS ahead_pad
FROM fr a JOIN fr b ON b.episode_index = a.episode_index AND b.frame_index = greatest(a.frame_index - 3, 0) JOIN fr c ON c.episode_index = a.episode_index AND c.frame_index = least(a.frame_index + 2, a.length - 1)
""")
def i2_look_around(spark, sf_dir):
    rows = _run_silent(spark, sf_dir, lambda s: T.look_around(s, "s0", 3, 2, **SILENT))
    return rows.select("episode_index", "frame_index", F.round("back_value", 4).alias("back_value"), F.round("ahead_value", 4).alias("ahead_value"), "back_pad", "ahead_pad")


@query("SELECT event_id, frame_index, ROUND(frame_index / 30, 5) AS timestamp FROM fr")
def i3_recording(spark, sf_dir):
    rows = _run_silent(spark, sf_dir, lambda s: T.record(s, 30.0, **SILENT))
    return rows.select("event_id", "frame_index", F.round("timestamp", 5).alias("timestamp"))


def _incremental(spark, sf_dir, cols):
    folder = new_folder(spark)
    rows = _arriving(spark, sf_dir)
    files = S.arrivals(rows, "part", f"{folder}/in")
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = S.incremental_stats(stream, cols, f"{folder}/stats", f"{folder}/marks")
    q.processAllAvailable()
    q.stop()
    return S.stored_stats(spark, f"{folder}/stats")


@query("SELECT 's0' AS feature, COUNT(*) AS count, ROUND(MIN(s0), 4) AS min, ROUND(AVG(s0), 6) AS mean, ROUND(STDDEV_POP(s0), 6) AS std FROM fr")
def i4_incremental_stats(spark, sf_dir):
    """Stats merged from all batches equal those over all frames."""
    return _incremental(spark, sf_dir, ["s0"]).select("feature", "count", F.round("min", 4).alias("min"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""
, l AS (SELECT 's0' AS feature, s0 AS v FROM fr UNION ALL SELECT 's1', s1 FROM fr)
SELECT feature, q.q AS quantile, COUNT(*) AS n, true AS near FROM l, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) q(q) WHERE v IS NOT NULL GROUP BY ALL
""")
def i4_incremental_quantiles(spark, sf_dir):
    """Quantiles from the batches' merged histograms, held against exact ranks over all frames."""
    from trajframe.operators.stats import QUANTILES, quantile_key
    from trajframe.plans.statistics import _near

    found = _incremental(spark, sf_dir, ["s0", "s1"])
    return _near(frames(spark, sf_dir), found.select("feature", F.inline(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(quantile_key(q)).alias("value")) for q in QUANTILES)))), 0.02)


@query("""
, kept AS (
  SELECT episode_index, frame_index FROM fr WHERE frame_index = 0
  UNION ALL
  SELECT k.episode_index, MIN(f.frame_index) FROM kept k JOIN fr c ON c.episode_index = k.episode_index AND c.frame_index = k.frame_index
  JOIN fr f ON f.episode_index = k.episode_index AND f.frame_index > k.frame_index AND sqrt(pow(f.s0 - c.s0, 2) + pow(f.s1 - c.s1, 2)) >= 20 GROUP BY k.episode_index)
SELECT episode_index, frame_index FROM kept
""")
def i5_similarity_gate(spark, sf_dir):
    return _run(spark, sf_dir, lambda s: S.similarity_gate(s, ["s0", "s1"], 20.0))


@query("SELECT COUNT(*) AS frames, COUNT(*) FILTER (event_id % 3 = 0) AS replays FROM fr")
def i5_replays(spark, sf_dir):
    """Every third frame is sent twice; what is left, and what the stream reports to have dropped."""
    sent = _arriving(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows, progress = S.run_stream(spark, sent, "part", lambda s: T.without_replays(s, ["episode_index", "event_id"], "ts", SILENT["delay"]), new_folder(spark))
    return rows.agg(F.count(F.lit(1)).alias("frames")).withColumn("replays", F.lit(T.dropped_replays(progress)).cast("long"))


def _shaped(s):
    """Each frame sends an action for six steps on and one for five steps on, which merges with the one before; every fourth sends
    the latter for the step that has just been executed."""
    near = F.col("frame_index") + F.when(F.col("frame_index") % 4 == 0, 0).otherwise(5)
    return s.select("episode_index", F.explode(F.array(near, F.col("frame_index") + 6)).alias("target"), F.col("s0").alias("value"), F.col("frame_index").alias("executed"), "is_last")


@query("SELECT COUNT(*) FILTER (frame_index % 4 = 0) AS late, COUNT(*) + COUNT(*) FILTER (frame_index % 4 <> 0) AS queued FROM fr")
def i6_late_counts(spark, sf_dir):
    """Late and queued actions as the stream's own reports count them, without a look at its output."""
    _, progress = S.run_stream(spark, _arriving(spark, sf_dir), "part", lambda s: S.late_actions(_shaped(s)), new_folder(spark))
    counts = [F.lit(T.observed(progress, "actions", n)).cast("long").alias(n) for n in ("late", "queued")]
    return spark.range(1).select(*counts)


@query("""
, p AS (SELECT episode_index, frame_index AS f, s0, coalesce(0.3 * lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index) + 0.7 * s0, s0) AS merged FROM fr)
SELECT episode_index, f + 6 AS target, ROUND(s0, 4) AS value, FALSE AS late FROM p
UNION ALL SELECT episode_index, CASE WHEN f % 4 = 0 THEN f ELSE f + 5 END, ROUND(CASE WHEN f % 4 = 0 THEN s0 ELSE merged END, 4), f % 4 = 0 FROM p
""")
def i6_late_actions(spark, sf_dir):
    rows = _run(spark, sf_dir, lambda s: S.late_actions(_shaped(s)))
    return rows.select("episode_index", "target", F.round("value", 4).alias("value"), "late")


@query("""
, m AS (SELECT *, CASE WHEN task = 'signup' THEN 1 ELSE 0 END AS e FROM fr), n AS (SELECT *, SUM(e) OVER (PARTITION BY episode_index ORDER BY frame_index) AS n FROM m),
o AS (SELECT episode_index, t AS t0 FROM n WHERE e = 1 AND n % 2 = 1)
SELECT episode_index, frame_index FROM n WHERE n % 2 = 1 OR (e = 1 AND n % 2 = 0)
UNION SELECT n.episode_index, n.frame_index FROM n JOIN o ON o.episode_index = n.episode_index AND n.t <= o.t0 AND o.t0 - n.t <= 86400
""")
def i7_pre_roll(spark, sf_dir):
    rows = _run_silent(spark, sf_dir, lambda s: T.pre_roll(s.withColumn("event", F.col("task") == "signup"), "event", "t", 86400.0, **SILENT))
    return rows.select("episode_index", "frame_index")


@query("""
, m AS (SELECT *, task IN ('click', 'view') AS en FROM fr), e AS (SELECT *, en AND NOT coalesce(lag(en) OVER (PARTITION BY episode_index ORDER BY frame_index), FALSE) AS edge FROM m)
SELECT episode_index, frame_index, ROUND(coalesce((s0 - lag(s0) OVER w) / 0.1::DOUBLE, 0), 3) AS velocity, frame_index + 1 >= 40 AS truncated,
  ROUND(last_value(CASE WHEN edge THEN s0 END IGNORE NULLS) OVER w, 4) AS reference, ROUND(last_value(CASE WHEN en THEN s0 END IGNORE NULLS) OVER w, 4) AS command
FROM e WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def i8_row_features(spark, sf_dir):
    rows = _run_silent(spark, sf_dir, lambda s: T.row_features(s.withColumn("on", F.col("task").isin("click", "view")), "s0", 0.1, 40, "on", **SILENT))
    return rows.select("episode_index", "frame_index", F.round("velocity", 3).alias("velocity"), "truncated", F.round("reference", 4).alias("reference"), F.round("command", 4).alias("command"))


@query("SELECT task, COUNT(*) AS n, ROUND((COUNT(*) - 1) / (MAX(t) - MIN(t)) * 1000, 6) AS rate FROM fr GROUP BY 1")
def i9_rates(spark, sf_dir):
    """The aggregate is kept by the stream; its last result is over all that has arrived."""
    rows = _run(spark, sf_dir, lambda s: S.rates(s, "task", "t"), "complete")
    return rows.select("task", "n", F.round(F.col("rate") * 1000, 6).alias("rate"))
