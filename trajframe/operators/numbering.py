"""Dense numbering and running offsets.

Nothing here runs a window over all frames: numbers are found per bucket of episodes and then per episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Episodes of one bucket: the only window without a partition runs over one row per bucket.
BUCKET = 4096


def cumulative_offsets(rows: DataFrame, size: str, order: str, start: str, end: str, group: str | None = None) -> DataFrame:
    """Adds the running sum of ``size`` before (start) and after (end) each row, by an integer ``order``, within ``group``."""
    bucketed = rows.withColumn("__bucket", F.floor(F.col(order) / BUCKET))
    by = [group] if group else []
    sums = bucketed.groupBy(*by, "__bucket").agg(F.sum(size).alias("__sum"))
    running = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "__bucket", F.coalesce(F.sum("__sum").over(running), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = bucketed.join(bases, [*by, "__bucket"]).withColumn(end, (F.col("__base") + F.sum(size).over(inside)).cast("long"))
    return out.withColumn(start, (F.col(end) - F.col(size)).cast("long")).drop("__bucket", "__base").select(*rows.columns, start, end)


def dense_numbers(ids: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): 0, 1, ... by rising integer ``col``, which must be distinct."""
    counted = cumulative_offsets(ids.select(col, F.lit(1).alias("__one")), "__one", col, out, "__end")
    return counted.select(col, out)


def kept_episodes(known: DataFrame, episode: str = "episode_index", length: str = "length") -> DataFrame:
    """(episode, length, new_episode_index, new_from_index) of episodes (episode, length): dense numbers and offsets in one pass over them."""
    rows = known.select(episode, length).withColumn("__bucket", F.floor(F.col(episode) / BUCKET))
    sums = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"), F.sum(length).alias("__sum"))
    running = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__bucket", *(F.coalesce(F.sum(c).over(running), F.lit(0)).alias(f"{c}0") for c in ("__n", "__sum")))
    inside = Window.partitionBy("__bucket").orderBy(episode)
    out = rows.join(F.broadcast(bases), "__bucket").select(
        episode,
        length,
        (F.col("__n0") + F.row_number().over(inside) - 1).cast("long").alias("new_episode_index"),
        (F.col("__sum0") + F.sum(length).over(inside) - F.col(length)).cast("long").alias("new_from_index"),
    )
    return out


def renumber(frames: DataFrame, kept: DataFrame, episode: str = "episode_index", frame: str = "frame_index") -> DataFrame:
    """Frames of the kept episodes (see ``kept_episodes``), with dense ``new_episode_index`` and ``new_index``: one join."""
    numbered = kept.select(episode, "new_episode_index", F.col("new_from_index").alias("__from"))
    return frames.join(numbered, episode).withColumn("new_index", F.col("__from") + F.col(frame)).drop("__from")
