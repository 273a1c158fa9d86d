"""Samples and orders: evenly spaced, episode-aware, shuffled, by fraction, mixed, newest."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajframe.operators.windows import EPISODE, FRAME


def sample_size(length: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    """How many frames stand for an episode: length^power, at least ``least`` (or all), at most ``most``."""
    return F.greatest(F.least(F.lit(least), length), F.least(F.pow(length.cast("double"), power).cast("int"), F.lit(most)))


def hashed(*cols: Column) -> Column:
    """A number below 2^32 from a hash of some columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in cols))), 1, 8), 16, 10).cast("long")


def evenly_spaced(episodes: DataFrame, **bounds) -> DataFrame:
    """(episode, frame): indices rounded, half to even, from equal steps between the first and last frame."""
    n = sample_size(F.col("length"), **bounds)
    rows = episodes.where("length > 0").select(EPISODE, "length", n.alias("n")).select(EPISODE, "length", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    at = F.when(F.col("n") > 1, F.col("i") * ((F.col("length") - 1) / (F.col("n") - 1).cast("double"))).otherwise(F.lit(0.0))
    return rows.select(EPISODE, F.bround(at).cast("long").alias(FRAME))


def episode_sampler(frames: DataFrame, drop_first: int = 0, drop_last: int = 0, episodes: list[int] | None = None, seed: int | None = None) -> DataFrame:
    """Frames without the first and last of each episode; ``frames`` has the length. With a seed in a pseudo-random order."""
    if episodes is not None:
        frames = frames.where(F.col(EPISODE).isin(episodes))
    kept = frames.where((F.col(FRAME) >= drop_first) & (F.col(FRAME) < F.col("length") - drop_last))
    if kept.isEmpty():
        raise ValueError("no frame is left to sample: the dropped ends cover every episode")
    return kept if seed is None else shuffled(kept, [EPISODE, FRAME], seed)


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """All rows in an order that a hash of their keys gives: the same for the same seed, sorted by ranges."""
    return rows.orderBy(hashed(*(F.col(k) for k in keys), F.lit(seed)), *keys)


def buffered_shuffle(rows: DataFrame, seed: int, buffer: int = 10_000) -> DataFrame:
    """All rows with ``shard`` and ``place``: the order in which a training job reads them, shards by a hash of their numbers, and within each as a buffer of ``buffer`` rows
    lets them go. Nothing is sorted or shuffled: each task streams its part of the files through its buffer, and a row may come any number of rows later
    than it stands there, and earlier by the buffer and a batch at most. The same files, seed and buffer give the same order."""
    names = rows.columns

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held, place, shard = None, 0, TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, shard])
        number_of_shard = int(np.random.default_rng([seed, shard, 1]).integers(1 << 62))

        def sent(table: pa.Table):
            nonlocal place
            n = table.num_rows
            placed = table.append_column("shard", pa.array(np.full(n, number_of_shard))).append_column("place", pa.array(np.arange(place, place + n)))
            place += n
            yield from placed.to_batches()

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows > buffer:
                order = rng.permutation(held.num_rows)
                out = held.num_rows - buffer
                yield from sent(held.take(pa.array(order[:out])))
                held = held.take(pa.array(order[out:])).combine_chunks()
        if held is not None and held.num_rows:
            yield from sent(held.take(pa.array(rng.permutation(held.num_rows))))

    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType()), T.StructField("place", T.LongType())])
    return rows.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(work, schema)


def fraction_per_episode(rows: DataFrame, fraction: float, rank: Column, order: str = FRAME) -> DataFrame:
    """max(1, int(n fraction)) rows of each episode, those with the smallest ``rank``."""
    w = Window.partitionBy(EPISODE)
    numbered = rows.withColumn("__r", F.row_number().over(w.orderBy(rank, order))).withColumn("__n", F.count(F.lit(1)).over(w))
    return numbered.where(F.col("__r") <= F.greatest(F.lit(1), (F.col("__n") * fraction).cast("int"))).drop("__r", "__n")


def with_replacement(rows: DataFrame, index: str, size: int, draws: int, seed: int) -> DataFrame:
    """``draws`` rows (at most ``size``, the number of rows), each picked by a hash of the draw's number from a dense index: a row may come again."""
    n = min(draws, size)
    spark = rows.sparkSession
    picks = spark.range(n).select(F.col("id").alias("draw"), (hashed(F.col("id"), F.lit(seed)) % size).alias(index))
    return rows.join(picks, index)


def mixed_batch(online: DataFrame, offline: DataFrame, index: str, sizes: tuple[int, int], batch: int, ratio: float, seed: int = 0) -> DataFrame:
    """max(1, int(batch ratio)) online draws and offline ones for the rest."""
    n = max(1, int(batch * ratio))
    a = with_replacement(online, index, sizes[0], n, seed).withColumn("source", F.lit("online"))
    return a.unionByName(with_replacement(offline, index, sizes[1], batch - n, seed + 1).withColumn("source", F.lit("offline")))


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)
