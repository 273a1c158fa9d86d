"""Edits of datasets: delete, merge, split, re-task, add and drop features, register tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.operators.numbering import cumulative_offsets, dense_numbers, kept_episodes, renumber

REQUIRED = ("timestamp", "frame_index", "episode_index", "index", "task_index")


def delete_episodes(frames: DataFrame, gone: list[int], episodes: DataFrame | None = None) -> DataFrame:
    """Frames without some episodes, numbered anew in ``new_episode_index`` and ``new_index``. Task ids keep their old order.

    With ``episodes`` (episode_index, length) nothing is counted over frames.
    """
    if not gone:
        raise ValueError("no episodes to delete")
    known = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length")) if episodes is None else episodes
    left = known.where(~F.col("episode_index").isin(gone))
    if left.isEmpty():
        raise ValueError("all episodes would be deleted")
    return renumber(frames, kept_episodes(left))


def merge_tasks(parts: list[DataFrame]) -> DataFrame:
    """(task, task_index) over all dictionaries, in order of first appearance."""
    named = [p.select("task", F.struct(F.lit(i).alias("part"), F.col("task_index")).alias("place")) for i, p in enumerate(parts)]
    first = reduce(DataFrame.unionByName, named).groupBy("task").agg(F.min("place").alias("place"))
    return first.select("task", (F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("task_index"))


def merge_datasets(parts: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Frames and tasks of several (frames, tasks, episodes): episodes and indices are shifted by what comes before, tasks re-mapped.

    Offsets come from the episodes' metadata (a row for each part), so every frame is read once.
    """
    tasks = merge_tasks([t for _, t, _ in parts])
    tagged = []
    for i, (frames, own, _) in enumerate(parts):
        rows = frames.join(own.select("task", "task_index"), "task_index").drop("task_index")
        tagged.append(rows.withColumn("__part", F.lit(i)))
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    known = reduce(DataFrame.unionByName, [e.select(F.lit(i).alias("__part"), "episode_index", "length") for i, (_, _, e) in enumerate(parts)])
    sizes = known.groupBy("__part").agg((F.max("episode_index") + 1).alias("e"), F.sum("length").alias("f"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("de"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("df"))
    out = every.join(F.broadcast(shifts), "__part").join(tasks, "task")
    out = out.withColumn("episode_index", F.col("episode_index") + F.col("de")).withColumn("index", F.col("index") + F.col("df"))
    return out.drop("de", "df").withColumnRenamed("__part", "dataset_index"), tasks


def common_features(parts: list[DataFrame]) -> DataFrame:
    """The parts below each other with the columns that all have, and ``dataset_index``."""
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    if not shared:
        raise ValueError("no feature is common to all datasets")
    return reduce(DataFrame.unionByName, [p.select(*(F.col(f"`{c}`") for c in shared), F.lit(i).alias("dataset_index")) for i, p in enumerate(parts)])


def agreement(meta: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(column, value, agreed): each column's value where all rows agree, else null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    one = meta.agg(*(F.struct(F.count_distinct(text(c)).alias("n"), F.min(text(c)).alias("v")).alias(c) for c in cols))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(f"{c}.n") == 1, F.col(f"{c}.v")).alias("value"), (F.col(f"{c}.n") == 1).alias("agreed")) for c in cols))))
    return rows


def retask(frames: DataFrame, default: str | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames (with ``task``) under new tasks: the episode's override, else the default, else its first task. Ids go by name."""
    first = frames.groupBy("episode_index").agg(F.min_by("task", "frame_index").alias("__first"))
    known = first
    if overrides is not None:
        known = known.join(overrides.select("episode_index", F.col("task").alias("__over")), "episode_index", "left")
    else:
        known = known.withColumn("__over", F.lit(None).cast("string"))
    known = known.select("episode_index", F.coalesce("__over", F.lit(default).cast("string"), "__first").alias("task"))
    tasks = known.select("task").distinct().withColumn("task_index", (F.row_number().over(Window.orderBy("task")) - 1).cast("long"))
    renamed = known.join(tasks, "task")
    return frames.drop("task", "task_index").join(renamed, "episode_index"), tasks


def register_tasks(known: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with unseen tasks behind, in order of name."""
    unseen = new.select("task").distinct().join(known, "task", "left_anti")
    most = known.agg(F.coalesce(F.max("task_index") + 1, F.lit(0)).alias("m"))
    added = unseen.crossJoin(F.broadcast(most)).select("task", (F.row_number().over(Window.orderBy("task")) - 1 + F.col("m")).cast("long").alias("task_index"))
    return known.select("task", F.col("task_index").cast("long").alias("task_index")).unionByName(added)


def modify_features(frames: DataFrame, add: dict[str, Column] | None = None, remove: list[str] | None = None) -> DataFrame:
    """One projection: columns go and come. Required columns stay, unknown and double names are errors."""
    add, remove = add or {}, remove or []
    for c in remove:
        if c in REQUIRED:
            raise ValueError(f"{c} is required")
        if c not in frames.columns:
            raise ValueError(f"no feature {c}")
    for c in add:
        if c in frames.columns and c not in remove:
            raise ValueError(f"feature {c} exists")
    return frames.select(*(F.col(f"`{c}`") for c in frames.columns if c not in remove), *(v.alias(c) for c, v in add.items()))


def add_feature_values(frames: DataFrame, values: DataFrame, index: str = "index") -> DataFrame:
    """Frames with the columns of ``values``, joined on the global index."""
    clash = set(values.columns) & set(frames.columns) - {index}
    if clash:
        raise ValueError(f"features exist: {sorted(clash)}")
    return frames.join(values, index, "left")


def split_by_fraction(episodes: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(episode_index, split): consecutive runs of int(N f) episodes in the order given; the last takes the rest, empty ones are skipped."""
    if sum(fractions.values()) > 1 + 1e-9:
        raise ValueError("fractions sum to more than 1")
    n = episodes.count()
    numbered = dense_numbers(episodes, "episode_index", "__n")
    names, start = list(fractions), 0
    label = F.lit(None).cast("string")
    for i, name in enumerate(names):
        size = n - start if i == len(names) - 1 else int(n * fractions[name])
        if size:
            label = F.when((F.col("__n") >= start) & (F.col("__n") < start + size), F.lit(name)).otherwise(label)
        start += size
    return numbered.select("episode_index", label.alias("split")).where("split IS NOT NULL")


def split_by_lists(episodes: DataFrame, lists: dict[str, list[int]]) -> DataFrame:
    """(episode_index, split, new_episode_index): disjoint, non-empty lists of known episodes, numbered within each."""
    flat = [e for ids in lists.values() for e in ids]
    if not all(lists.values()):
        raise ValueError("a split is empty")
    if len(set(flat)) < len(flat):
        raise ValueError("splits overlap")
    label = F.coalesce(*(F.when(F.col("episode_index").isin(ids), F.lit(name)) for name, ids in lists.items()))
    named = episodes.select("episode_index", label.alias("split")).where("split IS NOT NULL")
    if named.count() < len(flat):
        raise ValueError("a split names an unknown episode")
    one = named.withColumn("__one", F.lit(1))
    return cumulative_offsets(one, "__one", "episode_index", "new_episode_index", "__end", "split").drop("__one", "__end")


def hold_out(episodes: DataFrame, fraction: float) -> DataFrame:
    """The last max(1, round(N fraction)) episodes, half to even."""
    n = episodes.count()
    return episodes.where(F.col("episode_index") >= n - max(1, round(n * fraction)))


def map_files(rows: DataFrame, mapping: DataFrame, default: tuple[int, int]) -> DataFrame:
    """Rows (src_chunk, src_file) with dst_chunk, dst_file; files that the map doesn't know go to the default."""
    out = rows.join(mapping, ["src_chunk", "src_file"], "left")
    return out.withColumn("dst_chunk", F.coalesce("dst_chunk", F.lit(default[0]))).withColumn("dst_file", F.coalesce("dst_file", F.lit(default[1])))


def assemble_metadata(parts: dict[str, DataFrame], key: str = "episode_index") -> DataFrame:
    """One row for each key over all parts, and ``missing``, the parts that don't know it."""
    marked = [p.withColumn(f"__in_{n}", F.lit(True)) for n, p in parts.items()]
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), marked)
    missing = F.array_compact(F.array(*(F.when(F.col(f"__in_{n}").isNull(), F.lit(n)) for n in parts)))
    return out.withColumn("missing", missing).drop(*(f"__in_{n}" for n in parts))
