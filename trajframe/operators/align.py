"""Alignment of series with their own clocks: as-of joins, interpolation, range and interval joins.

The as-of family unions both sides and carries the last or next sample along the key's time order: one shuffle, one
window, no join-then-minimum. Keys are episodes; a window holds one episode. With ``long_keys`` an episode may be of any length: it is dealt to
tasks by ranges of time, and each range is handed the last sample before it and the first behind it (``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.operators.scan import next_marked, ranged


def _both(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Left rows (side 1) and right rows (side 0) under one schema; at one instant right rows come first."""
    named = F.struct(*(F.col(c) for c in left.columns))
    sample = F.struct(F.col(time).alias("t"), *(F.col(v) for v in values))
    a = left.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), named.alias("__left"))
    b = right.where(F.col(time).isNotNull()).select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(0).alias("__side"), sample.alias("__sample"))
    return a.unionByName(b, allowMissingColumns=True)


def _beside(rows: DataFrame, long_keys: bool, ends: bool = False) -> DataFrame:
    """Rows with the last sample at or before them (__b) and the first at or after them (__a); with ``ends`` the key's __first and __last as well."""
    sample = F.col("__sample")
    if long_keys:
        # Rows of one instant are in one range, so samples of that instant are found on either way.
        dealt = ranged(rows.withColumn("__back", -F.col("__side")), ["__k"], ["__t"])
        out = next_marked(dealt, ["__k"], ["__t", "__side"], sample, "__b", forward=True)
        out = next_marked(out, ["__k"], ["__t", "__back"], sample, "__a")
        if ends:
            whole = dealt.where(sample.isNotNull()).groupBy("__k").agg(F.min_by("__sample", "__t").alias("__first"), F.max_by("__sample", "__t").alias("__last"))
            out = out.join(whole.withColumnRenamed("__k", "__k2"), F.col("__k").eqNullSafe(F.col("__k2")), "left").drop("__k2")
        return out
    order = Window.partitionBy("__k").orderBy("__t", "__side")
    back = Window.partitionBy("__k").orderBy(F.col("__t").desc(), "__side")
    upto, every = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)
    # Seen from the end, samples of the same instant also come first, so "at or after" includes them.
    found = {"__b": F.last(sample, ignorenulls=True).over(order.rowsBetween(*upto)), "__a": F.last(sample, ignorenulls=True).over(back.rowsBetween(*upto))}
    if ends:
        found |= {"__first": F.first(sample, ignorenulls=True).over(order.rowsBetween(*every)), "__last": F.last(sample, ignorenulls=True).over(order.rowsBetween(*every))}
    return rows.withColumns(found)


def _chosen(how: str, clip: bool) -> Column:
    """The sample that a direction takes of those beside a row."""
    if how not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {how!r}")
    if how == "nearest":
        closer = F.col("__a.t") - F.col("__t") < F.col("__t") - F.col("__b.t")
        return F.when(F.col("__b").isNull() | closer, F.coalesce("__a", "__b")).otherwise(F.col("__b"))
    near, end = ("__b", "__first") if how == "backward" else ("__a", "__last")
    return F.coalesce(near, end) if clip else F.col(near)


def asof_each(left: DataFrame, right: DataFrame, key: str, time: str, value: str, ways: dict[str, tuple[str, bool]], long_keys: bool = False) -> DataFrame:
    """Left rows with a column for each of ``ways`` (name: direction, clip): the value that ``asof`` gives in that way. Both sides are dealt once for all of them."""
    chosen = {n: _chosen(how, clip) for n, (how, clip) in ways.items()}
    ends = any(clip and how != "nearest" for how, clip in ways.values())
    rows = _beside(_both(left, right, key, time, [value]), long_keys, ends).withColumns({f"__m_{n}": c for n, c in chosen.items()})
    return rows.where("__side = 1").select("__left.*", *(F.col(f"__m_{n}.{value}").alias(n) for n in ways))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], how: str = "backward", tolerance: float | None = None, clip: bool = False, long_keys: bool = False) -> DataFrame:
    """Left rows with the right values at the sample chosen by ``how``, and its time as ``match_t``.

    backward: the latest at or before; forward: the first at or after; nearest: the closer of both (ties: the earlier).
    ``clip`` falls back to the key's first (backward) or last (forward) sample. ``within_tol`` says whether the
    match lies closer than ``tolerance``; without a sample it is null like the values.
    """
    rows = _beside(_both(left, right, key, time, values), long_keys, clip and how != "nearest").withColumn("__m", _chosen(how, clip))
    out = rows.where("__side = 1").select("__left.*", F.col("__m.t").alias("match_t"), *(F.col(f"__m.{v}").alias(v) for v in values))
    return out if tolerance is None else out.withColumn("within_tol", F.abs(F.col("match_t") - F.col(time)) < tolerance)


def interpolate(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], long_keys: bool = False) -> DataFrame:
    """Left rows with right values interpolated linearly; held constant outside the samples. Samples with NaN don't count."""
    clean = right
    for v in values:
        clean = clean.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    rows = _beside(_both(left, clean, key, time, values), long_keys)

    def at(v: str) -> Column:
        a, b = F.col(f"__a.{v}"), F.col(f"__b.{v}")
        gap = F.col("__a.t") - F.col("__b.t")
        line = b + (a - b) * (F.col("__t") - F.col("__b.t")) / F.nullif(gap, F.lit(0.0))
        return F.coalesce(line, b, a)

    return rows.where("__side = 1").select("__left.*", *(at(v).alias(v) for v in values))


def index_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, default: dict | None = None) -> DataFrame:
    """Points with the columns of the range that holds them (start <= at < end), of ranges that don't overlap, such as episodes' indices. Points outside of all
    ranges are left out, or with ``default`` get its values (null where it has none).

    Both sides are dealt by sampled boundaries of the index, and what reaches over a boundary is handed on, so ranges may be of one row or of millions
    and no point or range is multiplied."""
    names = [c for c in ranges.columns if c not in points.columns]
    held = F.struct(F.col(end).alias("__end"), *(F.col(c) for c in names))
    a = points.select(F.col(at).cast("long").alias("__t"), F.lit(1).alias("__side"), F.struct(*(F.col(c) for c in points.columns)).alias("__left"))
    b = ranges.where(F.col(start) < F.col(end)).select(F.col(start).cast("long").alias("__t"), F.lit(0).alias("__side"), held.alias("__range_of"))
    rows = ranged(a.unionByName(b, allowMissingColumns=True), [], ["__t"])
    found = next_marked(rows, [], ["__t", "__side"], F.col("__range_of"), "__m", forward=True).where("__side = 1")
    inside = F.coalesce(F.col("__t") < F.col("__m.__end"), F.lit(False))
    if default is None:
        return found.where(inside).select("__left.*", *(F.col(f"__m.{c}").alias(c) for c in names))
    return found.select("__left.*", *(F.when(inside, F.col(f"__m.{c}")).otherwise(F.lit(default.get(c))).alias(c) for c in names))


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with all the ranges, which may overlap, that hold them (start <= at < end). Both sides meet in cells of ``width``, so it is an
    equi-join; a range takes part in every cell that it touches. For ranges that don't overlap, see ``index_join``."""
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    dealt = ranges.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(cells))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(dealt, "__cell").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def interval_join(frames: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, pos: str) -> DataFrame:
    """Frames with the first interval (by ``pos``) of their key that holds them, both ends included; else nulls.

    The intervals of a key are few (annotations of an episode) and come as one array, so no frame is multiplied.
    """
    kinds = [c for c in intervals.columns if c != key]
    held = intervals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, *(c for c in kinds if c != pos)))).alias("__i"))
    joined = frames.join(held, key, "left")
    first = F.get(F.filter("__i", lambda i: (i[start] <= F.col(at)) & (F.col(at) <= i[end])), F.lit(0))
    return joined.withColumn("__f", first).select(*frames.columns, *(F.col(f"__f.{c}").alias(c) for c in kinds))


def time_sync(states: DataFrame, actions: DataFrame, camera: DataFrame, key: str, time: str, state_cols: list[str], action_cols: list[str], frame_col: str, fps: float) -> DataFrame:
    """A grid of 1 / fps from the latest start to the earliest end (exclusive): states interpolated, actions held, the next camera frame."""
    ends = None
    for s in (states, actions, camera):
        b = s.groupBy(key).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
        ends = b if ends is None else ends.unionByName(b)
    both = ends.groupBy(key).agg(F.max("__lo").alias("lo"), F.min("__hi").alias("hi"), F.count(F.lit(1)).alias("streams")).where("streams = 3 AND hi > lo")
    steps = F.ceil((F.col("hi") - F.col("lo")) * fps).cast("long")
    grid = both.select(key, "lo", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("step")).select(key, "step", (F.col("lo") + F.col("step") / fps).alias(time))
    grid = interpolate(grid, states, key, time, state_cols)
    grid = asof(grid, actions, key, time, action_cols, "backward", clip=True).drop("match_t")
    return asof(grid, camera, key, time, [frame_col], "forward", clip=True).drop("match_t")
