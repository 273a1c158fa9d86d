"""Windows and sequences inside an episode, in frame order.

Every window is partitioned by episode. An episode too large for one task has the join form of the delta window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajframe.operators.scan import RANGE, ranged
from trajframe.streaming.storage import stored

EPISODE, FRAME = "episode_index", "frame_index"


def in_order(episode: str = EPISODE, frame: str = FRAME) -> WindowSpec:
    return Window.partitionBy(episode).orderBy(frame)


def whole(episode: str = EPISODE, frame: str = FRAME) -> WindowSpec:
    return in_order(episode, frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def shifted(value: Column, k: int, w: WindowSpec) -> Column:
    return F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else value


#: Frames of a piece of a long episode, without those that it borrows.
PIECE = 65_536


def in_pieces(frames: DataFrame, back: int, ahead: int, piece: int | None = PIECE) -> tuple[DataFrame, WindowSpec]:
    """Frames dealt by pieces of their episode, and the window over a piece in order, for operators that look at most ``back`` and ``ahead`` frames away.

    Each piece borrows so many frames of its neighbours; its own are marked ``__core``, and only these are to be kept. Frame numbers are dense. Without a
    ``piece`` an episode is one."""
    if piece is None:
        return frames.withColumn("__core", F.lit(True)).withColumn("__piece", F.lit(0).cast("long")), in_order()
    own = F.floor(F.col(FRAME) / piece)
    first, last = F.greatest(F.lit(0), F.floor((F.col(FRAME) - ahead) / piece)), F.floor((F.col(FRAME) + back) / piece)
    rows = frames.withColumn("__piece", F.explode(F.sequence(first, last))).withColumn("__core", F.col("__piece") == own)
    return rows, Window.partitionBy(EPISODE, "__piece").orderBy(FRAME)


def delta_window(frames: DataFrame, col: str, deltas: list[int], padding: str = "clamp", out: str | None = None) -> DataFrame:
    """Adds ``out`` (values at each delta) and ``out_is_pad``.

    clamp: beyond the episode's end stands its first or last value. nearest_success: beyond it stands the
    value at the furthest requested delta that is still inside, else the frame's own.
    """
    out = out or f"{col}_window"
    w, ends, value = in_order(), whole(), F.col(f"`{col}`")
    here = F.col(FRAME)
    last = F.max(here).over(ends)
    first = F.min(here).over(ends)
    outside = [(here + d > last) | (here + d < first) for d in deltas]
    values = []
    for d in deltas:
        if padding == "clamp":
            edge = F.last(value).over(ends) if d > 0 else F.first(value).over(ends)
            values.append(F.when(here + d > last, edge).when(here + d < first, edge).otherwise(shifted(value, d, w)))
        elif padding == "nearest_success":
            nearer = sorted((x for x in deltas if x * d > 0 and abs(x) < abs(d)), key=lambda x: -abs(x))
            choice = F.when(~((here + d > last) | (here + d < first)), shifted(value, d, w))
            for x in nearer:
                choice = choice.when(~((here + x > last) | (here + x < first)), shifted(value, x, w))
            values.append(choice.otherwise(value))
        else:
            raise ValueError(f"unknown padding {padding!r}")
    return frames.withColumn(out, F.array(*values)).withColumn(f"{out}_is_pad", F.array(*outside))


def delta_window_by_join(frames: DataFrame, col: str, deltas: list[int]) -> DataFrame:
    """(episode, frame, delta, value, is_pad) by a self-join: for long lists of deltas and episodes larger than a task.

    ``frames`` has the episode's length.
    """
    at = F.col(FRAME) + F.col("delta")
    wanted = frames.select(EPISODE, FRAME, "length", F.explode(F.array(*(F.lit(d).cast("long") for d in deltas))).alias("delta"))
    wanted = wanted.withColumn("at", F.least(F.greatest(at, F.lit(0)), F.col("length") - 1)).withColumn("is_pad", (at < 0) | (at >= F.col("length")))
    source = frames.select(EPISODE, F.col(FRAME).alias("at"), F.col(col).alias("value"))
    return wanted.join(source, [EPISODE, "at"]).select(EPISODE, FRAME, "delta", "value", "is_pad")


def action_chunks(frames: DataFrame, action: str, horizon: int, state: str | None = None, mask: list[bool] | None = None) -> DataFrame:
    """(episode, frame, chunk array<array>) for every start with ``horizon`` frames left; relative to the first state if one is given."""
    ahead = in_order().rowsBetween(0, horizon - 1)
    chunks = frames.withColumn("chunk", F.collect_list(action).over(ahead)).where(F.size("chunk") == horizon)
    if state:
        on = F.array(*(F.lit(1.0 if m else 0.0) for m in mask)) if mask else None
        less = lambda a: F.transform(a, lambda x, i: x - F.get(F.col(state), i) * (F.coalesce(F.get(on, i), F.lit(1.0)) if on is not None else 1.0))
        chunks = chunks.withColumn("chunk", F.transform("chunk", less))
    return chunks.select(EPISODE, FRAME, "chunk")


def symmetric_deltas(steps: int, gap: int) -> list[int]:
    half = steps // 2
    return [gap * k for k in range(-half, half + 1)]


def rewind(frames: DataFrame, max_steps: int, gap: int) -> DataFrame:
    """(episode, frame, step, at): earlier frames in reverse, as many as the history holds, at most ``max_steps``."""
    steps = F.least(F.floor(F.col(FRAME) / gap), F.lit(max_steps)).cast("int")
    rows = frames.where(steps > 0).select(EPISODE, FRAME, F.explode(F.sequence(F.lit(1), steps)).alias("step"))
    return rows.withColumn("at", F.col(FRAME) - F.col("step") * gap)


def gradient(value: Column, time: Column, w: WindowSpec | None = None) -> Column:
    """Derivative over uneven steps: second order inside and one-sided second order at both ends; null under three frames."""
    w = w or in_order()
    at = lambda c, k: shifted(c, k, w)
    h1, h2 = time - at(time, -1), at(time, 1) - time
    inner = (at(value, 1) * h1 * h1 + value * (h2 * h2 - h1 * h1) - at(value, -1) * h2 * h2) / F.nullif(h1 * h2 * (h1 + h2), F.lit(0.0))

    def end(s: int) -> Column:
        a, b = at(time, s) - time, at(time, 2 * s) - at(time, s)
        return (-(2 * a + b) / F.nullif(a * (a + b), F.lit(0.0))) * value + ((a + b) / F.nullif(a * b, F.lit(0.0))) * at(value, s) - (a / F.nullif(b * (a + b), F.lit(0.0))) * at(value, 2 * s)

    return F.when(at(time, -1).isNull(), end(1)).when(at(time, 1).isNull(), end(-1)).otherwise(inner)


def unwrapped(angle: Column, w: WindowSpec | None = None) -> Column:
    """Angles without jumps of more than half a turn: the running sum of each step's whole turns is taken off.

    A step of exactly half a turn keeps its sign.
    """
    w = w or in_order()
    turn = 2 * 3.141592653589793
    step = angle - F.lag(angle).over(w)
    wrapped = F.pmod(step + turn / 2, F.lit(turn)) - turn / 2
    wrapped = F.when((wrapped == -turn / 2) & (step > 0), turn / 2).otherwise(wrapped)
    fix = F.when(F.abs(step) < turn / 2, 0.0).otherwise(wrapped - step)
    return fix


def with_gradient(frames: DataFrame, value: Column, time: Column, out: str, piece: int | None = PIECE) -> DataFrame:
    """Adds ``gradient`` of a value, for episodes of any length."""
    rows, w = in_pieces(frames, 2, 2, piece)
    return rows.withColumn(out, gradient(value, time, w)).where("__core").drop("__core", "__piece")


def unwrap(frames: DataFrame, col: str, out: str, piece: int | None = None) -> DataFrame:
    """Adds ``out``, the angles of ``col`` unwrapped along each episode. With a ``piece`` the turns of earlier pieces are handed on, a row for each."""
    rows, w = in_pieces(frames, 1, 0, piece)
    fixed = rows.withColumn("__fix", F.coalesce(unwrapped(F.col(col), w), F.lit(0.0))).where("__core").drop("__core")
    inside = F.sum("__fix").over(Window.partitionBy(EPISODE, "__piece").orderBy(FRAME))
    if piece is None:
        return fixed.withColumn(out, F.col(col) + inside).drop("__fix", "__piece")
    sums = fixed.groupBy(EPISODE, "__piece").agg(F.sum("__fix").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(EPISODE).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(EPISODE, "__piece", F.coalesce(before, F.lit(0.0)).alias("__before"))
    return fixed.withColumn("__in", inside).join(bases, [EPISODE, "__piece"]).withColumn(out, F.col(col) + F.col("__before") + F.col("__in")).select(*frames.columns, out)


def path_length(frames: DataFrame, cols: list[str], piece: int | None = None) -> DataFrame:
    """(episode, path_length): the sum of distances between neighbouring frames."""
    rows, w = in_pieces(frames, 1, 0, piece)
    d2 = sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in cols), F.lit(0.0))
    return rows.select(EPISODE, "__core", F.sqrt(d2).alias("d")).where("__core").groupBy(EPISODE).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("path_length"))


def trapezoid(frames: DataFrame, value: Column, time: Column, piece: int | None = None) -> DataFrame:
    """(episode, integral) by the trapezoid rule."""
    rows, w = in_pieces(frames, 1, 0, piece)
    area = (value + F.lag(value).over(w)) / 2 * (time - F.lag(time).over(w))
    return rows.select(EPISODE, "__core", area.alias("p")).where("__core").groupBy(EPISODE).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("integral"))


def transitions(frames: DataFrame, state: list[str], done: Column | None = None, force_truncated: bool | None = None) -> DataFrame:
    """Adds next_<state>, done, truncated: behind a done frame or the last one stands the frame's own state."""
    w = in_order()
    is_last = F.lead(FRAME).over(w).isNull()
    done = is_last if done is None else done
    out = frames.withColumn("done", done)
    for c in state:
        out = out.withColumn(f"next_{c}", F.when(F.col("done") | is_last, F.col(c)).otherwise(F.lead(c).over(w)))
    return out.withColumn("truncated", F.col("done") if force_truncated is None else F.lit(force_truncated))


def velocity(frames: DataFrame, cols: list[str], dt: float, piece: int | None = None) -> DataFrame:
    """Adds vel_<col>, zero on the first frame."""
    rows, w = in_pieces(frames, 1, 0, piece)
    return rows.withColumns({f"vel_{c}": F.coalesce((F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0)) for c in cols}).where("__core").drop("__core", "__piece")


def segments(rows: DataFrame, key: str, order: list[str], ends: Column, out: str = "segment") -> DataFrame:
    """Adds a number that rises behind every row where ``ends`` holds."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = rows.withColumn("__end", ends.cast("int"))
    return flagged.withColumn(out, F.coalesce(F.sum("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("__end")


def upsample(frames: DataFrame, col: str, factor: int) -> DataFrame:
    """(episode, frame, sub, value): ``factor`` rows from the last value to this one; the first passes through once."""
    before = F.lag(col).over(in_order())
    rows = frames.select(EPISODE, FRAME, F.col(col).alias("v"), before.alias("b"))
    subs = rows.withColumn("sub", F.explode(F.sequence(F.lit(1), F.when(F.col("b").isNull(), 1).otherwise(factor))))
    value = F.when(F.col("b").isNull(), F.col("v")).otherwise(F.col("b") + (F.col("v") - F.col("b")) * F.col("sub") / factor)
    return subs.select(EPISODE, FRAME, "sub", value.alias("value"))


def temporal_ensemble(chunks: DataFrame, coefficient: float) -> DataFrame:
    """(episode, target, value) from (episode, start_step, actions array<double>): predictions for one step are averaged
    with weights exp(-c i), i = 0 for the oldest chunk."""
    rows = chunks.select(EPISODE, "start_step", F.posexplode("actions").alias("k", "a")).withColumn("target", F.col("start_step") + F.col("k"))
    age = F.row_number().over(Window.partitionBy(EPISODE, "target").orderBy("start_step")) - 1
    weighed = rows.withColumn("w", F.exp(-coefficient * age))
    return weighed.groupBy(EPISODE, "target").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("value"), F.count(F.lit(1)).alias("n"))


#: Two-argument functions that merge the queued value of a step with a newer one; users may add theirs.
MERGES = {
    "weighted_average": lambda old, new: 0.3 * old + 0.7 * new,
    "latest_only": lambda old, new: new,
    "average": lambda old, new: 0.5 * old + 0.5 * new,
    "conservative": lambda old, new: 0.7 * old + 0.3 * new,
}


def merge_overlaps(chunks: DataFrame, how: str = "weighted_average", executed: Column | None = None) -> DataFrame:
    """(episode, target, value): the queued actions of a step folded in order of arrival; ``executed`` and earlier steps are dropped.

    A step is predicted by at most a chunk's length of chunks, so the folded arrays are short.
    """
    if how not in MERGES:
        raise ValueError(f"unknown merge {how!r}")
    rows = chunks.select(EPISODE, "start_step", "arrival", F.posexplode("actions").alias("k", "a")).withColumn("target", F.col("start_step") + F.col("k"))
    if executed is not None:
        rows = rows.where(F.col("target") > executed)
    queued = rows.groupBy(EPISODE, "target").agg(F.sort_array(F.collect_list(F.struct("arrival", "start_step", "a"))).alias("q"))
    folded = F.aggregate(F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))), F.get("q", 0)["a"], lambda acc, x: MERGES[how](acc, x["a"]))
    return queued.select(EPISODE, "target", folded.alias("value"), F.size("q").cast("long").alias("n"))


def replace_late(chunks: DataFrame, delay: int) -> DataFrame:
    """(episode, target, value, chunk): the value of the latest chunk that covers a step behind its first ``delay`` actions."""
    rows = chunks.select(EPISODE, "start_step", F.posexplode("actions").alias("k", "a")).where(F.col("k") >= delay)
    rows = rows.withColumn("target", F.col("start_step") + F.col("k"))
    return rows.groupBy(EPISODE, "target").agg(F.max_by("a", "start_step").alias("value"), F.max("start_step").alias("chunk"))


def latch(frames: DataFrame, enabled: str, pose: str) -> DataFrame:
    """Adds ``reference`` (the pose at the last rising edge of ``enabled``) and ``command`` (the last pose while enabled)."""
    w = in_order()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.col(enabled) & ~F.coalesce(F.lag(enabled).over(w), F.lit(False))
    marked = frames.withColumn("__edge", edge)
    out = marked.withColumn("reference", F.last(F.when(F.col("__edge"), F.col(pose)), ignorenulls=True).over(so_far))
    return out.withColumn("command", F.last(F.when(F.col(enabled), F.col(pose)), ignorenulls=True).over(so_far)).drop("__edge")


def clip_and_flag(frames: DataFrame, col: str, low: float, high: float, max_step: float) -> DataFrame:
    """Adds ``clipped`` and ``jump``, whether it lies more than ``max_step`` from the last clipped value."""
    out = frames.withColumn("clipped", F.least(F.greatest(F.col(col), F.lit(low)), F.lit(high)))
    return out.withColumn("jump", F.coalesce(F.abs(F.col("clipped") - F.lag("clipped").over(in_order())) > max_step, F.lit(False)))


def islands(frames: DataFrame, flag: str) -> DataFrame:
    """(episode, island, first_frame, last_frame, n): contiguous runs of frames where ``flag`` holds."""
    w = in_order()
    starts = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    runs = frames.withColumn("__s", starts).withColumn("island", F.sum("__s").over(w)).where(F.col(flag))
    return runs.groupBy(EPISODE, "island").agg(F.min(FRAME).alias("first_frame"), F.max(FRAME).alias("last_frame"), F.count(F.lit(1)).alias("n"))


def pre_roll(frames: DataFrame, event: Column, time: str, seconds: float) -> DataFrame:
    """The frames from ``seconds`` before an odd event (save on) up to the next one (save off), or to the end.

    Both ends are found by windows over the episode: a frame is kept while saving is on, or if it turns on within ``seconds``.
    """
    w = in_order()
    marked = frames.withColumn("__e", event.cast("int")).withColumn("__n", F.sum("__e").over(w))
    on = (F.col("__n") % 2 == 1) | ((F.col("__e") == 1) & (F.col("__n") % 2 == 0))
    starts = F.when((F.col("__e") == 1) & (F.col("__n") % 2 == 1), F.col(time))
    following = F.first(starts, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    kept = marked.withColumn("saving", on).withColumn("__next", following)
    return kept.where(F.col("saving") | (F.col("__next") - F.col(time) <= seconds)).drop("__e", "__n", "__next")


def strided(frames: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th frame of an episode and its last; ``frames`` has the length."""
    return frames.where((F.col(FRAME) % stride == 0) | (F.col(FRAME) == F.col("length") - 1))


def rotate(frames: DataFrame, time: Column, seconds: float) -> DataFrame:
    """Adds ``part``: the episode is closed every ``seconds`` from its start."""
    first = F.first(time).over(whole())
    return frames.withColumn("part", F.floor((time - first) / seconds).cast("long"))


def _unlike(cols: list[str], tolerance: float):
    """A fold for groupBy(episode, ...): the frames of some rows that are at least ``tolerance`` from the last kept one, the first being compared with __entry, if there is one."""
    import numpy as np
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(FRAME)
        entry = rows["__entry"].iloc[0] if len(rows) else None
        points, kept = rows[cols].to_numpy(float), []
        last = None if entry is None else np.array(entry, float)
        for i, p in enumerate(points):
            if last is None or np.linalg.norm(p - last) >= tolerance:
                kept.append(i)
                last = p
        return rows.iloc[kept][[EPISODE, RANGE, FRAME, "__p"]]

    return fold


def drop_near_duplicates(frames: DataFrame, cols: list[str], tolerance: float) -> DataFrame:
    """(episode, frame) of the frames at least ``tolerance`` from the last kept one, which is all that the fold carries.

    Episodes of any length: each is dealt to tasks by ranges of frames. First every range is folded as if nothing came before it; then, in turns, ranges whose
    predecessors have ended with another kept frame than they began from are folded again. A fold mostly falls back to the same frames, so that what it hands on doesn't change;
    after turn k the first k ranges of an episode are final."""
    point = F.array(*(F.col(c).cast("double") for c in cols))
    rows = ranged(frames.select(EPISODE, FRAME, *cols).withColumn("__p", point), [EPISODE], [FRAME])
    by, kinds = [EPISODE, RANGE], dict(rows.dtypes)
    schema = f"{EPISODE} {kinds[EPISODE]}, {RANGE} int, {FRAME} {kinds[FRAME]}, __p array<double>"
    folded = lambda rows: stored(rows.groupBy(*by).applyInPandas(_unlike(cols, tolerance), schema))
    places = stored(rows.select(*by).distinct())
    used = stored(places.withColumn("__entry", F.lit(None).cast("array<double>")))
    kept = folded(rows.withColumn("__entry", F.lit(None).cast("array<double>")))
    while True:
        ends = places.join(kept.groupBy(*by).agg(F.max_by("__p", FRAME).alias("__end")), by, "left")
        before = Window.partitionBy(EPISODE).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        entries = ends.select(*by, F.last("__end", ignorenulls=True).over(before).alias("__entry"))
        new = stored(entries.join(used.withColumnRenamed("__entry", "__used"), by).where(~F.col("__entry").eqNullSafe(F.col("__used"))).select(*by, "__entry"))
        if new.isEmpty():
            return kept.select(EPISODE, FRAME)
        again = folded(rows.join(new, by))
        kept = stored(kept.join(new.select(*by), by, "left_anti").unionByName(again))
        used = stored(used.join(new.select(*by), by, "left_anti").unionByName(new))
