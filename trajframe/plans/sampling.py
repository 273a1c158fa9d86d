"""Queries over samples and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajframe.operators import sampling as S
from trajframe.plans.registry import query
from trajframe.plans.views import episodes, frames, table

KEYS = ("episode_index", "frame_index")


@query("""
, n AS (SELECT o_custkey AS episode_index, COUNT(*) * 40 AS length FROM orders GROUP BY 1),
k AS (SELECT *, greatest(least(100, length), least(CAST(trunc(pow(length, 0.75)) AS BIGINT), 10000)) AS n FROM n)
SELECT episode_index, CAST(round_even(i.i * ((length - 1) / (n - 1)), 0) AS BIGINT) AS frame_index FROM k, range(0, 10000) i(i) WHERE i.i < n AND n > 1
""")
def f1_evenly_spaced(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_index")).agg((F.count(F.lit(1)) * 40).alias("length"))
    return S.evenly_spaced(rows)


@query("SELECT episode_index, frame_index FROM fr WHERE frame_index >= 5 AND frame_index < length - 3 AND episode_index IN (1, 2, 3, 50)")
def f2_episode_sampler(spark, sf_dir):
    return S.episode_sampler(frames(spark, sf_dir), 5, 3, [1, 2, 3, 50]).select(*KEYS)


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT idx) AS n_distinct, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS overlaps, MIN(CAST('0x' || substr(md5(idx || ':3'), 1, 8) AS BIGINT)) AS first_key FROM fr")
def f3_shuffle(spark, sf_dir):
    """A permutation: every frame once, rising by a hash of index and seed inside each partition and from one partition to the next."""
    rows = S.shuffled(frames(spark, sf_dir).select("idx"), ["idx"], 3)
    placed = rows.select("idx", S.hashed(F.col("idx"), F.lit(3)).alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    steps = placed.withColumn("late", F.col("k") < F.lag("k").over(Window.partitionBy("p").orderBy("at")))
    parts = steps.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("d"), F.count_if("late").alias("late"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    parts = parts.withColumn("overlap", F.col("lo") < F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.agg(F.sum("n").alias("n"), F.sum("d").alias("n_distinct"), F.sum("late").alias("out_of_order"), F.count_if("overlap").alias("overlaps"), F.min("lo").alias("first_key"))


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT idx) AS n_distinct, COUNT(*) AS places, true AS moved, CAST(0 AS BIGINT) AS exchanges FROM fr")
def f3_buffered_shuffle(spark, sf_dir):
    """A permutation without a sort: every frame once, each in a place of its own, most in another one than in the files, and no exchange in its plan."""
    rows = S.buffered_shuffle(frames(spark, sf_dir).select("idx"), 3, 500)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    back = Window.partitionBy("shard").orderBy("place")
    placed = rows.withColumn("step", F.col("idx") - F.lag("idx").over(back))
    one = placed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("n_distinct"), F.count_distinct("shard", "place").alias("places"), (F.count_if(F.col("step") == 1) * 10 < F.count(F.lit(1))).alias("moved"))
    return one.withColumn("exchanges", F.lit(plan.count("Exchange")).cast("long"))


@query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY (idx * 7919) % 10007, frame_index) AS r FROM fr)
SELECT episode_index, frame_index FROM r WHERE r <= greatest(1, CAST(floor(length * 0.1) AS BIGINT))
""")
def f4_fraction_per_episode(spark, sf_dir):
    return S.fraction_per_episode(frames(spark, sf_dir), 0.1, (F.col("idx") * 7919) % 10007).select(*KEYS)


@query("""
, n AS (SELECT COUNT(*) AS c FROM fr)
SELECT CAST(i.i AS BIGINT) AS draw, fr.idx, CASE WHEN k.k = 0 THEN 'online' ELSE 'offline' END AS source
FROM n, (VALUES (0, 64), (1, 192)) k(k, m), range(0, 192) i(i), fr WHERE i.i < k.m AND fr.idx = CAST('0x' || substr(md5(i.i || ':' || k.k), 1, 8) AS BIGINT) % n.c
""")
def f5_mixed_batch(spark, sf_dir):
    rows = frames(spark, sf_dir).select("idx")
    n = episodes(spark, sf_dir).agg(F.sum("length")).first()[0]
    return S.mixed_batch(rows, rows, "idx", (n, n), 256, 0.25).select("draw", "idx", "source")


@query("SELECT episode_index, frame_index, idx FROM fr WHERE idx >= (SELECT COUNT(*) FROM fr) - 500")
def f6_keep_newest(spark, sf_dir):
    return S.newest(frames(spark, sf_dir), ["idx"], 500).select(*KEYS, "idx")


@query("SELECT idx, episode_index FROM fr")
def f11_global_order(spark, sf_dir):
    return frames(spark, sf_dir).select("idx", "episode_index").orderBy("idx")
