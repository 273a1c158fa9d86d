"""Queries over statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajframe.operators import histogram as H
from trajframe.operators import stats as S
from trajframe.plans.registry import query
from trajframe.plans.views import frames, table

_PER = """
, per AS (
  SELECT episode_index, 's0' AS feature, COUNT(*) AS count, MIN(s0) AS min, MAX(s0) AS max, AVG(s0) AS mean, STDDEV_POP(s0) AS std, quantile_cont(s0, 0.01) AS q01, quantile_cont(s0, 0.5) AS q50, quantile_cont(s0, 0.99) AS q99 FROM fr GROUP BY 1
  UNION ALL
  SELECT episode_index, 's1', COUNT(*), MIN(s1), MAX(s1), AVG(s1), STDDEV_POP(s1), quantile_cont(s1, 0.01), quantile_cont(s1, 0.5), quantile_cont(s1, 0.99) FROM fr GROUP BY 1)
"""
_COLS = ("min", "max", "mean", "std", "q01", "q50", "q99")
#: Values with few decimals lie on the edge of rounding; a hair more moves them off it in both engines.
_R = ", ".join(f"ROUND({c} + 1e-8, 6) AS {c}" for c in _COLS)


def _rounded(df, *keys):
    return df.select(*keys, "count", *(F.round(F.col(c) + 1e-8, 6).alias(c) for c in _COLS))


@query(_PER + f"SELECT episode_index, feature, count, {_R} FROM per")
def d1_per_episode_stats(spark, sf_dir):
    return _rounded(S.per_episode_stats(frames(spark, sf_dir), ["s0", "s1"], (0.01, 0.5, 0.99)), "episode_index", "feature")


_MERGED = _PER + """
, mu AS (SELECT feature, SUM(count) AS n, SUM(count * mean) / SUM(count) AS mu FROM per GROUP BY 1),
mg AS (SELECT p.feature, CAST(SUM(count) AS BIGINT) AS count, MIN(min) AS min, MAX(max) AS max, ANY_VALUE(mu.mu) AS mean, SQRT(SUM(count * (std * std + (mean - mu.mu) * (mean - mu.mu))) / SUM(count)) AS std,
  SUM(count * q01) / SUM(count) AS q01, SUM(count * q50) / SUM(count) AS q50, SUM(count * q99) / SUM(count) AS q99 FROM per p JOIN mu ON mu.feature = p.feature GROUP BY 1)
"""


@query(_MERGED + f"SELECT feature, count, {_R} FROM mg")
def d2_merged_stats(spark, sf_dir):
    return _rounded(S.merge_stats(S.per_episode_stats(frames(spark, sf_dir), ["s0", "s1"], (0.01, 0.5, 0.99))), "feature")


@query("""
, e AS (SELECT task, MIN(s0) - 1e-10 AS lo, MAX(s0) + 1e-10 AS hi, COUNT(*) AS n FROM fr GROUP BY 1),
b AS (SELECT fr.task, lo, hi, n, least(CAST(floor((s0 - lo) / ((hi - lo) / 500)) AS INTEGER), 499) AS bin, COUNT(*) AS c FROM fr JOIN e ON e.task = fr.task GROUP BY ALL),
u AS (SELECT *, SUM(c) OVER (PARTITION BY task ORDER BY bin) AS cum FROM b),
h AS (SELECT u.*, q.q FROM u, (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) q(q) WHERE cum >= q.q * n AND cum - c < q.q * n)
SELECT task, q AS quantile, ROUND(CASE WHEN bin = 0 THEN lo ELSE lo + bin * ((hi - lo) / 500) + (q * n - (cum - c)) / c * ((hi - lo) / 500) END, 3) AS value FROM h
""")
def d3_histogram_quantiles(spark, sf_dir):
    return S.histogram_quantiles(frames(spark, sf_dir), ["task"], "s0", (0.01, 0.5, 0.9), 500).withColumn("value", F.round("value", 3))

def _sql_bin(v: str, lo: str, hi: str, bins: int, moved: bool) -> str:
    """The bin of a value; of an old centre, whose bin is closed on the right, if ``moved``."""
    step, near = f"(({hi} - {lo}) / {bins})", "ceil" if moved else "floor"
    k = f"greatest(0, least({bins - 1}, CAST({near}(({v} - {lo}) / {step}) AS INTEGER) {'- 1' if moved else ''}))"
    below, above = ("<=", ">") if moved else ("<", ">=")
    return f"list_transform([{k}], lambda k: k - (k > 0 AND {v} {below} k * {step} + {lo})::INT + (k < {bins - 1} AND {v} {above} (k + 1) * {step} + {lo})::INT)[1]"


@query(f"""
, v AS (SELECT frame_index // 16 AS b, s0 AS v FROM fr),
m AS (SELECT b, MIN(v) AS lo, MAX(v) AS hi FROM v GROUP BY b),
r AS (SELECT b, MIN(lo) OVER w AS mn, MAX(hi) OVER w AS mx, MIN(lo) OVER p AS mn0, MAX(hi) OVER p AS mx0 FROM m
      WINDOW w AS (ORDER BY b), p AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT b, mn, mx, CAST(SUM(CASE WHEN mn < mn0 OR mx > mx0 THEN 1 ELSE 0 END) OVER (ORDER BY b) AS INTEGER) AS turn FROM r),
e AS (SELECT turn, arg_min(mn, b) - CASE WHEN turn = 0 THEN 1e-10::DOUBLE ELSE (arg_min(mx, b) - arg_min(mn, b)) * 1e-10::DOUBLE END AS lo,
        arg_min(mx, b) + CASE WHEN turn = 0 THEN 1e-10::DOUBLE ELSE (arg_min(mx, b) - arg_min(mn, b)) * 1e-10::DOUBLE END AS hi FROM s GROUP BY turn),
tr AS (
  SELECT e.turn, {_sql_bin("v.v", "e.lo", "e.hi", 200, False)} AS bin FROM v JOIN s ON s.b = v.b JOIN e ON e.turn = s.turn
  UNION ALL
  SELECT turn, {_sql_bin("c", "lo", "hi", 200, True)} FROM (
    SELECT n.turn, n.lo, n.hi, ((tr.bin * ((o.hi - o.lo) / 200) + o.lo) + CASE WHEN tr.bin = 199 THEN o.hi ELSE (tr.bin + 1) * ((o.hi - o.lo) / 200) + o.lo END) / 2 AS c
    FROM tr JOIN e o ON o.turn = tr.turn JOIN e n ON n.turn = tr.turn + 1) x)
SELECT bin, COUNT(*) AS c, ROUND(ANY_VALUE(e.lo), 6) AS lo, ROUND(ANY_VALUE(e.hi), 6) AS hi FROM tr JOIN e ON e.turn = tr.turn WHERE tr.turn = (SELECT MAX(turn) FROM e) GROUP BY bin
""")
def d3_grown_histogram(spark, sf_dir):
    """A running histogram over batches of frames, whose range grows with them: the counts after the last batch."""
    rows = frames(spark, sf_dir).select(F.lit("s0").alias("feature"), F.lit(0).alias("dim"), F.floor(F.col("frame_index") / 16).alias("batch"), "s0")
    found = H.grown_histograms(rows, "feature", "dim", "batch", "s0", 200)
    return found.select(F.posexplode("counts").alias("bin", "c"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")).where("c > 0")


_RANKED = ", l AS (SELECT 's0' AS feature, s0 AS v FROM fr UNION ALL SELECT 's1', s1 FROM fr) SELECT feature, q.q AS quantile, COUNT(*) AS n, true AS near FROM l, (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) q(q) WHERE v IS NOT NULL GROUP BY ALL"


def _near(rows, quantiles, by: float):
    """(feature, quantile, n, near): whether an estimated quantile (feature, quantile, value) lies between the exact ranks q - by and q + by; ``quantiles`` has a few rows."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("s0", "s1"))))).where("v IS NOT NULL")
    counted = long.join(F.broadcast(quantiles), "feature").groupBy("feature", "quantile").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto")
    )
    near = (F.col("below") <= (F.col("quantile") + by) * F.col("n")) & (F.col("upto") >= (F.col("quantile") - by) * F.col("n"))
    return counted.select("feature", "quantile", "n", near.alias("near"))


@query(_RANKED)
def d2_merged_sketches(spark, sf_dir):
    """Quantiles from episodes' sketches merged, held against exact ranks."""
    rows, qs = frames(spark, sf_dir), (0.01, 0.5, 0.99)
    merged = S.sketch_quantiles(S.merge_sketches(S.episode_sketches(rows, ["s0", "s1"])), qs)
    return _near(rows, merged.select("feature", F.inline(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(S.quantile_key(q)).alias("value")) for q in qs)))), 0.03)


@query(_RANKED)
def d3_merged_histograms(spark, sf_dir):
    """Quantiles from episodes' histograms merged, held against exact ranks: with 5,000 bins they are off by the values of a bin or two."""
    rows, qs = frames(spark, sf_dir), (0.01, 0.5, 0.99)
    long = rows.select("episode_index", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("s0", "s1")))))
    merged = H.merged_parts(long, ["episode_index"], ["feature"], "v")
    return _near(rows, H.quantiles_of(merged, ["feature"], qs), 0.02)


@query(_MERGED + f", old AS (SELECT 's1' AS feature, CAST(7 AS BIGINT) AS count, 0.0::DOUBLE AS min, 1.0::DOUBLE AS max, 0.5::DOUBLE AS mean, 0.25::DOUBLE AS std, 0.0::DOUBLE AS q01, 0.5::DOUBLE AS q50, 1.0::DOUBLE AS q99 UNION ALL SELECT 'gone', 3, 0, 1, 0.5, 0.25, 0, 0.5, 1) SELECT feature, count, {_R} FROM mg UNION ALL SELECT feature, count, {_R} FROM old WHERE feature = 'gone'")
def d4_recomputed_stats(spark, sf_dir):
    new = S.merge_stats(S.per_episode_stats(frames(spark, sf_dir), ["s0", "s1"], (0.01, 0.5, 0.99)))
    old = spark.createDataFrame([("s1", 7, 0.0, 1.0, 0.5, 0.25, 0.0, 0.5, 1.0), ("gone", 3, 0.0, 1.0, 0.5, 0.25, 0.0, 0.5, 1.0)], "feature string, count long, " + ", ".join(f"{c} double" for c in _COLS))
    return _rounded(S.update_stats(old, new), "feature")


@query(_MERGED + "SELECT feature, count, ROUND(mean, 3) AS mean, ROUND(q01, 3) AS q01, ROUND(q50, 3) AS q50, ROUND(q99, 3) AS q99 FROM mg")
def d5_quantile_backfill(spark, sf_dir):
    full = S.merge_stats(S.per_episode_stats(frames(spark, sf_dir), ["s0", "s1"], (0.01, 0.5, 0.99)))
    filled = S.backfill_quantiles(full.drop("q01", "q50", "q99"), full)
    return filled.select("feature", "count", *(F.round(c, 3).alias(c) for c in ("mean", "q01", "q50", "q99")))


@query("""
, d AS (SELECT b.s0 - a.s0 AS d FROM fr a JOIN fr b ON a.episode_index = b.episode_index AND b.frame_index BETWEEN a.frame_index AND a.frame_index + 9 WHERE a.frame_index + 10 <= a.length)
SELECT COUNT(*) AS count, ROUND(MIN(d), 3) AS min, ROUND(MAX(d), 3) AS max, ROUND(AVG(d), 3) AS mean, ROUND(STDDEV_POP(d), 3) AS std FROM d
""")
def d6_relative_chunk_stats(spark, sf_dir):
    one = S.relative_chunk_stats(frames(spark, sf_dir), "s0", "s0", 10)
    return one.select("count", *(F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std")))


@query("""
, x AS (SELECT unnest(range(0, 64)) AS channel, unnest(embedding) AS v FROM embeddings)
SELECT CAST(channel AS INTEGER) AS channel, COUNT(*) AS count, ROUND(AVG(v::DOUBLE), 6) AS mean, ROUND(STDDEV_POP(v::DOUBLE), 6) AS std FROM x GROUP BY 1
""")
def d7_axis_stats_per_channel(spark, sf_dir):
    rows = S.axis_stats(table(spark, sf_dir, "embeddings"), "embedding", "channel")
    return rows.select("channel", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""
, x AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, COUNT(*) AS count, ROUND(MIN(v::DOUBLE), 5) AS min, ROUND(AVG(v::DOUBLE), 5) AS mean FROM x GROUP BY 1, 2
""")
def d1_vector_stats(spark, sf_dir):
    rows = S.vector_stats(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return rows.select("label", "dim", "count", F.round("min", 5).alias("min"), F.round("mean", 5).alias("mean"))


@query(_PER + """
, b AS (SELECT 'ep' || episode_index AS feature, CASE WHEN episode_index % 5 = 2 THEN 0 ELSE count END AS count, CASE WHEN episode_index % 5 = 0 THEN max + 1 ELSE min END AS min, max,
  CASE WHEN episode_index % 5 = 3 THEN NULL ELSE mean END AS mean, CASE WHEN episode_index % 5 = 1 THEN -1 ELSE std END AS std FROM per WHERE feature = 's0')
SELECT feature, 'count below one' AS problem FROM b WHERE count < 1 UNION ALL SELECT feature, 'min above max' FROM b WHERE min > max
UNION ALL SELECT feature, 'mean outside range' FROM b WHERE mean < min - 1e-9 OR mean > max + 1e-9 UNION ALL SELECT feature, 'negative std' FROM b WHERE std < 0
UNION ALL SELECT feature, 'missing value' FROM b WHERE mean IS NULL
""")
def d8_stats_violations(spark, sf_dir):
    """Statistics of every episode, four of five of them broken in some way."""
    per = S.per_episode_stats(frames(spark, sf_dir), ["s0"])
    kind = F.col("episode_index") % 5
    broken = per.select(
        F.concat(F.lit("ep"), "episode_index").alias("feature"),
        F.when(kind == 2, 0).otherwise(F.col("count")).alias("count"),
        F.when(kind == 0, F.col("max") + 1).otherwise(F.col("min")).alias("min"),
        "max",
        F.when(kind != 3, F.col("mean")).alias("mean"),
        F.when(kind == 1, F.lit(-1.0)).otherwise(F.col("std")).alias("std"),
    )
    return S.stats_violations(broken)


@query("SELECT 'embedding' || label AS feature, 'wrong shape' AS problem FROM embeddings WHERE label % 3 <> 0 GROUP BY label")
def d8_stats_shapes(spark, sf_dir):
    """A feature has stats for each of its values; a third of the labels say how many there are."""
    rows = table(spark, sf_dir, "embeddings")
    stats = S.vector_stats(rows, "embedding", "label").select(F.concat(F.lit("embedding"), "label").alias("feature"), "dim", "count", "min", "max", "mean", "std")
    labels = [r[0] for r in rows.select("label").distinct().collect()]  # ten of them
    return S.stats_violations(stats, {f"embedding{k}": 64 if k % 3 == 0 else 63 for k in labels})


@query("SELECT vec_id AS row, COUNT(*) AS count, ROUND(AVG(v::DOUBLE / 255), 9) AS mean, ROUND(STDDEV_POP(v::DOUBLE / 255), 9) AS std FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) x GROUP BY 1")
def d7_axis_stats_per_row(spark, sf_dir):
    """Pixels of each image as one: the row is the axis that stays."""
    rows = S.axis_stats(table(spark, sf_dir, "embeddings").select("embedding", "vec_id"), "embedding", "row", scale=255.0, keep=["vec_id"])
    return rows.select(F.col("vec_id").alias("row"), "count", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("SELECT task, ROUND(MIN(s0), 4) AS min_s0, ROUND(MAX(s0), 4) AS max_s0, ROUND(MIN(s1), 4) AS min_s1, ROUND(MAX(s1), 4) AS max_s1 FROM fr GROUP BY task")
def d24_limits(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("task").agg(*(f(c).alias(f"{n}_{c}") for c in ("s0", "s1") for n, f in (("min", lambda c: F.round(F.min(c), 4)), ("max", lambda c: F.round(F.max(c), 4)))))


@query("SELECT COUNT(*) AS n, ROUND(AVG(p), 6) AS mean, ROUND(STDDEV_POP(p), 6) AS std, MIN(p) AS min, ROUND(MAX(p), 6) AS max FROM (SELECT frame_index / length AS p FROM fr WHERE task <> 'error') x")
def d30_progress_describe(spark, sf_dir):
    p = F.when(F.col("task") == "error", F.lit(float("nan"))).otherwise(F.col("frame_index") / F.col("length"))
    return S.describe(frames(spark, sf_dir).withColumn("p", p), "p").select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", F.round("max", 6).alias("max"))
