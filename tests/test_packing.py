"""Packing by jumps against the fold that it replaces, and the ordered scans under it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trajframe.operators import packing, scan


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fold_files(sizes, limit):
    """File of each item: filled in order until the next item would reach the limit."""
    file, filled, out = 0, 0, []
    for s in sizes:
        if filled and filled + s >= limit:
            file, filled = file + 1, 0
        filled += s
        out.append(file)
    return out


def fold_batches(items, max_size, max_episodes, max_frames):
    batch, size, n, frames, out = 0, 0, 0, 0, []
    for s, f in items:
        if n and (size >= max_size or n >= max_episodes or frames + f > max_frames):
            batch, size, n, frames = batch + 1, 0, 0, 0
        size, n, frames = size + s, n + 1, frames + f
        out.append(batch)
    return out


@pytest.mark.parametrize("limit", [1, 7.5, 40])
def test_files_equal_the_fold(spark, limit):
    """Empty items in front, inside and behind; items above the limit; gaps in the order; a group of one item; a null size."""
    r = random.Random(int(limit))
    groups = {"a": [0, 0, 9, 0, 50, 0], "b": [r.choice([0, 0, 1, 2, 5, 30]) for _ in range(700)], "c": [3], "d": [0] * 5, "e": [None, 4, None, 4, 4]}
    rows = [(g, 3 * i + 1, None if s is None else float(s), "x") for g, sizes in groups.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, size double, pos string")
    got = {(x[0], x[1]): (x[2], x[3]) for x in packing.pack_files(df, limit, 3).collect()}
    want = {(g, 3 * i + 1): divmod(f, 3) for g, sizes in groups.items() for i, f in enumerate(fold_files([s or 0 for s in sizes], limit))}
    assert got == want


def test_many_files_over_many_ranges(spark):
    """One group over all tasks, thousands of files."""
    n = 100_000
    size = lambda i: (i * 7919) % 97 + (500 if i % 1013 == 0 else 0)
    df = spark.range(n).select(F.lit(0).alias("dataset"), F.col("id").alias("episode_index"), ((F.col("id") * 7919) % 97 + F.when(F.col("id") % 1013 == 0, 500).otherwise(0)).alias("size"))
    got = packing.pack_files(df, 300, 10).orderBy("episode_index").collect()
    assert [x["chunk_index"] * 10 + x["file_index"] for x in got] == fold_files(map(size, range(n)), 300)


@pytest.mark.parametrize("bounds", [(20, 5, 90), (15, 1000, 10_000)])
def test_batches_equal_the_fold(spark, bounds):
    r = random.Random(2)
    items = {g: [(r.choice([0, 1, 4, 25]), r.randint(0, 60)) for _ in range(n)] for g, n in (("a", 400), ("b", 1), ("c", 33))}
    rows = [(g, i, float(s), f) for g, own in items.items() for i, (s, f) in enumerate(own)]
    df = spark.createDataFrame(rows, "camera string, episode_index long, mb double, length long")
    got = {(x[0], x[1]): x[2] for x in packing.batch_episodes(df, "camera", "episode_index", "mb", "length", *bounds).collect()}
    assert got == {(g, i): b for g, own in items.items() for i, b in enumerate(fold_batches(own, *bounds))}


def test_nothing_to_pack(spark):
    none = spark.createDataFrame([], "dataset string, episode_index long, size double")
    assert packing.pack_files(none, 5).count() == 0


def test_scans_hand_on_over_ranges(spark):
    """Marked values far apart: whole ranges without one, and a group without any."""
    n = 20_000
    rows = spark.range(n).select(F.when(F.col("id") < 3, "b").otherwise("a").alias("g"), F.col("id").alias("o"), F.when(F.col("id").isin(10, 9_000), F.col("id")).alias("m"))
    placed = scan.ranged(rows, ["g"], ["o"])
    assert placed.select(scan.RANGE).distinct().count() > 1
    got = {(x["g"], x["o"]): x for x in scan.running_sums(scan.next_marked(scan.next_marked(placed, ["g"], ["o"], F.col("m"), "ahead"), ["g"], ["o"], F.col("m"), "behind", forward=True), ["g"], ["o"], {"n": F.lit(1)}).collect()}
    for o in (3, 9, 10, 11, 8_999, 9_000, 9_001, n - 1):
        x = got["a", o]
        assert (x["ahead"], x["behind"], x["n"]) == (10 if o < 10 else 9_000 if o < 9_000 else None, 9_000 if o > 9_000 else 10 if o > 10 else None, o - 3)
    assert [(got["b", o]["ahead"], got["b", o]["n"]) for o in range(3)] == [(None, 0), (None, 1), (None, 2)]
