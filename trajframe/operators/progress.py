"""Progress inside episodes: stages from annotated intervals, weights from progress made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.operators.windows import EPISODE, FRAME, delta_window, in_order, symmetric_deltas, whole


def tau(t: Column, start: Column, end: Column) -> Column:
    """Part of a stage that has passed, 0 to 1; a stage without duration is over."""
    return F.when(end <= start, 1.0).otherwise(F.least(F.greatest((t - start) / F.nullif(end - start, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def stage_and_tau(frames: DataFrame, intervals: DataFrame, at: str = FRAME, key: str = EPISODE, how: str = "inner") -> DataFrame:
    """Frames with ``stage`` (stage number + tau). ``intervals`` (key, pos, start, end) are an episode's stages in order.

    Inside a stage, ends included, the first that fits; before the first 0; after the last the last + .999; in a gap the stage before with
    tau 1. A single stage runs over the whole episode. Episodes without stages drop out; with ``how`` "left" they stay, their stage null.
    """
    held = intervals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end"))).alias("__s"))
    rows = frames.join(held, key, how)
    t, n = F.col(at).cast("double"), F.size("__s")
    hit = F.get(F.filter(F.transform("__s", lambda s, i: F.struct(i.alias("i"), s["start"].alias("a"), s["end"].alias("b"))), lambda s: (s["a"] <= t) & (t <= s["b"])), F.lit(0))
    before = F.size(F.filter("__s", lambda s: s["end"] < t))
    last = F.get("__s", n - 1)["end"]
    rows = rows.withColumn("__hit", hit)
    inside = F.col("__hit.i") + F.least(tau(t, F.col("__hit.a").cast("double"), F.col("__hit.b").cast("double")), F.when(F.col("__hit.i") == n - 1, 0.999).otherwise(1.0))
    stage = F.when(F.col("__hit").isNotNull(), inside).when(t < F.get("__s", F.lit(0))["start"], 0.0).when(t > last, n - 1 + 0.999).otherwise(F.greatest(before - 1, F.lit(0)) + 1.0)
    return rows.withColumn("stage", F.when(F.col("__s").isNotNull(), stage)).select(*frames.columns, "stage")


def proportions(intervals: DataFrame, key: str = EPISODE) -> DataFrame:
    """(name, proportion): a stage's share of its episode, averaged over the episodes that have it, scaled to 1.

    A name that an episode repeats keeps its last duration, but every repeat counts in the episode's total.
    """
    d = intervals.withColumn("d", (F.col("end") - F.col("start")).cast("double"))
    total = d.groupBy(key).agg(F.sum("d").alias("total"))
    last = d.groupBy(key, "name").agg(F.max_by("d", "pos").alias("d"))
    share = last.join(total, key).where("total > 0").groupBy("name").agg(F.avg(F.col("d") / F.col("total")).alias("p"))
    return share.select("name", (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("proportion"))


def breakpoints(parts: list[float]) -> list[float]:
    """Cumulative parts from 0 to exactly 1."""
    out, total = [0.0], sum(parts)
    for p in parts:
        out.append(out[-1] + p / total)
    out[-1] = 1.0
    return out


def to_progress(stage: Column, parts: list[float]) -> Column:
    """Stage + tau as progress from 0 to 1, linear between the breakpoints."""
    marks = F.array(*map(F.lit, breakpoints(parts)))
    i = F.least(F.greatest(F.floor(stage), F.lit(0)), F.lit(len(parts) - 1)).cast("int")
    a, b = F.get(marks, i), F.get(marks, i + 1)
    return F.least(F.greatest(a + (b - a) * (stage - i), F.lit(0.0)), F.lit(1.0))


def progress_weights(rows: DataFrame, progress: str, ahead: int, kappa: float, eps: float = 1e-6, fallback: float = 1.0) -> DataFrame:
    """Adds ``delta`` (progress ``ahead`` frames later, at most at the end, minus now) and ``weight``: 1 above kappa, 0 below 0,
    between them by where delta lies within two deviations of the mean; the fallback where progress is null or NaN."""
    p = F.nanvl(F.col(progress), F.lit(None).cast("double"))
    clean = rows.withColumn("__p", p)
    later = F.coalesce(F.lead("__p", ahead).over(in_order()), F.last("__p", ignorenulls=True).over(whole()))
    clean = clean.withColumn("delta", later - F.col("__p")).drop("__p")
    one = clean.agg(F.greatest(F.avg("delta"), F.lit(0.0)).alias("__m"), F.greatest(F.stddev_pop("delta"), F.lit(eps)).alias("__s"))
    soft = F.least(F.greatest((F.col("delta") - (F.col("__m") - 2 * F.col("__s"))) / (4 * F.col("__s") + eps), F.lit(0.0)), F.lit(1.0))
    weight = F.when(F.col("delta").isNull(), fallback).when(F.col("delta") > kappa, 1.0).when(F.col("delta") < 0, 0.0).otherwise(soft)
    return clean.crossJoin(F.broadcast(one)).withColumn("weight", weight).drop("__m", "__s")


def batch_normalised(rows: DataFrame, weight: str, batch: str, eps: float = 1e-6) -> DataFrame:
    """Adds ``scaled``: weights of a batch scaled to its number of rows."""
    w = Window.partitionBy(batch)
    return rows.withColumn("scaled", F.col(weight) * F.count(F.lit(1)).over(w) / (F.sum(weight).over(w) + eps))


#: Named strategies that give a weight column from a progress delta; unknown names are errors.
STRATEGIES = {"uniform": lambda rows, **k: rows.withColumn("weight", F.lit(1.0)), "progress": progress_weights}


def weigh(rows: DataFrame, strategy: str, **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](rows, **options)


def annotate(episodes: DataFrame, intervals: DataFrame, prefix: str, fps: float, key: str = EPISODE) -> DataFrame:
    """Episodes with {prefix}_subtask_{names,start_times,end_times,start_frames,end_frames}; without annotations one stage over the episode."""
    held = intervals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "start", "end"))).alias("__a"))
    auto = F.array(F.struct(F.lit(0).alias("pos"), F.lit("task").alias("name"), F.lit(0.0).alias("start"), (F.col("length") / fps).alias("end")))
    rows = episodes.join(held, key, "left").withColumn("__a", F.coalesce("__a", auto))
    get = lambda f: F.transform("__a", lambda a: a[f])
    frame = lambda f: F.transform("__a", lambda a: (a[f] * fps).cast("long"))
    p = f"{prefix}_subtask"
    return rows.withColumns({f"{p}_names": get("name"), f"{p}_start_times": get("start"), f"{p}_end_times": get("end"), f"{p}_start_frames": frame("start"), f"{p}_end_frames": frame("end")}).drop("__a")


def read_annotations(episodes: DataFrame, prefix: str, key: str = EPISODE) -> DataFrame:
    """(key, pos, name, start, end) back from the arrays on episodes."""
    p = f"{prefix}_subtask"
    zipped = F.arrays_zip(F.col(f"{p}_names").alias("name"), F.col(f"{p}_start_times").alias("start"), F.col(f"{p}_end_times").alias("end"))
    rows = episodes.select(key, F.posexplode(zipped).alias("pos", "z"))
    return rows.select(key, "pos", F.col("z.0").alias("name"), F.col("z.1").alias("start"), F.col("z.2").alias("end")) if "0" in rows.schema["z"].dataType.names else rows.select(key, "pos", "z.*")


def progress_targets(rows: DataFrame, stage: str, n_obs: int, max_rewind: int, gap: int, steps: Column) -> DataFrame:
    """(episode, frame, targets, rewound): ``stage`` at the slots that a sample of each frame has: n_obs + 1 frames around it, clamped at the episode's ends, then
    ``max_rewind`` slots of earlier frames in reverse, from before the first of those. As many of these are filled as ``steps`` says and the history
    holds; the rest are 0."""
    half = n_obs // 2
    back = [-(half + i) * gap for i in range(1, max_rewind + 1)]
    seen = delta_window(rows.withColumn("__steps", steps.cast("int")), stage, [*symmetric_deltas(n_obs, gap), *back])
    earliest = F.col(FRAME) - half * gap
    used = F.when(earliest > 0, F.greatest(F.lit(0), F.least(F.col("__steps"), F.lit(max_rewind), F.floor(earliest / gap).cast("int")))).otherwise(F.lit(0))
    kept = F.transform(f"{stage}_window", lambda x, i: F.when(i <= n_obs + F.col("rewound"), x).otherwise(F.lit(0.0)))
    return seen.withColumn("rewound", used).select(EPISODE, FRAME, kept.alias("targets"), "rewound")
