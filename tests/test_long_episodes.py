"""Episodes that are dealt over tasks give what they give in one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajframe.operators import align, sampling, windows


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture()
def sides(spark):
    """One episode with nearly all rows, one without samples, a null one; samples far apart, some at the very time of a row."""
    r = random.Random(1)
    left = [("a", float(t), i) for i, t in enumerate(r.choices(range(5000), k=800))] + [("b", 1.0, -1), (None, 5.0, -2), ("a", -3.0, -3), ("a", 9e9, -4)]
    right = [("a", float(t), t * 1.5) for t in r.sample(range(5000), k=60)] + [("c", 1.0, 1.0), (None, 4.0, 44.0), ("a", None, 0.0)]
    return spark.createDataFrame(left, "k string, t double, i long"), spark.createDataFrame(right, "k string, t double, v double")


@pytest.mark.parametrize(("how", "clip"), [("backward", False), ("backward", True), ("forward", True), ("nearest", False)])
def test_asof(sides, how, clip):
    both = [sorted(map(repr, align.asof(*sides, "k", "t", ["v"], how, 30.0, clip, long_keys=long).collect())) for long in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 804


def test_interpolation(sides):
    both = [sorted(map(repr, align.interpolate(*sides, "k", "t", ["v"], long_keys=long).collect())) for long in (False, True)]
    assert both[0] == both[1]


def test_ranges_of_any_length(spark):
    """Ranges of one index beside one of a million, gaps between them, empty ones; points on both ends and outside."""
    ranges, at = [], 0
    for e, n in enumerate([1, 1, 1_000_000, 0, 1, 50, 1, 300_000, 1]):
        at += 7 if e in (4, 6) else 0
        ranges.append((e, at, at + n))
        at += n
    points = sorted({-5, 0, 1, 2, 500_000, at, at + 9, *(x + d for _, lo, hi in ranges for x in (lo, hi) for d in (-1, 0, 1))} | set(range(1000, 900_000, 911)))
    df = spark.createDataFrame([(p, "p") for p in points], "i long, tag string")
    known = spark.createDataFrame(ranges, "e long, lo long, hi long")
    want = {p: next((e for e, lo, hi in ranges if lo <= p < hi), None) for p in points}
    got = {r["i"]: r["e"] for r in align.index_join(df, known, "i", "lo", "hi").collect()}
    assert got == {p: e for p, e in want.items() if e is not None}
    filled = {r["i"]: (r["e"], r["lo"]) for r in align.index_join(df, known, "i", "lo", "hi", {"e": -1}).collect()}
    assert filled == {p: (-1, None) if e is None else (e, ranges[e][1]) for p, e in want.items()}


@pytest.mark.parametrize("tolerance", [0.5, 3.0, 1e9])
def test_unlike_frames(spark, tolerance):
    """A random walk over all tasks, with a stretch that stands still over whole ranges; a short episode beside it."""
    rng = np.random.default_rng(int(tolerance))
    steps = rng.normal(0, 0.4, (12_000, 2))
    steps[3000:9000] = 0
    walk = np.cumsum(steps, axis=0)
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(walk)] + [(1, i, float(i), 0.0) for i in range(5)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, x double, y double")
    want = set()
    for e in (0, 1):
        last = None
        for _, i, x, y in (r for r in rows if r[0] == e):
            if last is None or np.hypot(x - last[0], y - last[1]) >= tolerance:
                want.add((e, i))
                last = (x, y)
    assert {tuple(r) for r in windows.drop_near_duplicates(frames, ["x", "y"], tolerance).collect()} == want


def test_buffered_shuffle(spark):
    rows = spark.range(0, 5000, 1, 3).select("id", F.concat(F.lit("n"), F.col("id")).alias("note"))
    one, two, other = (sampling.buffered_shuffle(rows, seed, 300).orderBy("shard", "place").collect() for seed in (1, 1, 2))
    assert one == two != other and [r["id"] for r in one] != [r["id"] for r in other]
    assert sorted(r["id"] for r in one) == list(range(5000)) and all(r["note"] == f"n{r['id']}" for r in one)
    assert len({(r["shard"], r["place"]) for r in one}) == 5000 and len({r["shard"] for r in one}) == 3
    assert sampling.buffered_shuffle(rows.limit(0), 1).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_pieces(spark, piece):
    """Derivatives, unwrapped angles, lengths and integrals of episodes cut into pieces, down to one frame."""
    rng = np.random.default_rng(piece)
    rows = [(e, i, float(t), *map(float, rng.uniform(-3, 3, 2))) for e, n in ((0, 61), (1, 1), (2, 2), (3, 7)) for i, t in enumerate(np.cumsum(rng.uniform(0.1, 1, n)))]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, t double, x double, y double")
    order = ["episode_index", "frame_index"]
    grown = [windows.with_gradient(frames, F.col("x"), F.col("t"), "g", p).orderBy(*order).collect() for p in (None, piece)]
    assert grown[0] == grown[1]
    turned = [windows.unwrap(frames, "x", "u", p).orderBy(*order).collect() for p in (None, piece)]
    assert np.allclose([r["u"] for r in turned[0]], [r["u"] for r in turned[1]]) and [tuple(r)[:5] for r in turned[1]] == rows
    assert windows.velocity(frames, ["x", "y"], 0.1, piece).orderBy(*order).collect() == windows.velocity(frames, ["x", "y"], 0.1).orderBy(*order).collect()
    for f in (lambda p: windows.path_length(frames, ["x", "y"], p), lambda p: windows.trapezoid(frames, F.col("x"), F.col("t"), p)):
        a, b = ([r[1] for r in f(p).orderBy("episode_index").collect()] for p in (None, piece))
        assert np.allclose(a, b) and len(a) == 4


@pytest.mark.parametrize("long_keys", [False, True])
def test_ways_of_one_deal_equal_those_of_their_own(spark, long_keys):
    left = spark.createDataFrame([(k, float(t), 100 * k + t) for k in (0, 1) for t in range(0, 40, 3)], "k long, t double, id long")
    right = spark.createDataFrame([(0, float(t), float(t * t)) for t in range(5, 30, 7)], "k long, t double, v double")
    ways = {"held": ("backward", True), "near": ("nearest", False), "coming": ("forward", True), "bare": ("backward", False)}
    got = align.asof_each(left, right, "k", "t", "v", ways, long_keys=long_keys)
    for name, (how, clip) in ways.items():
        own = align.asof(left, right, "k", "t", ["v"], how, clip=clip)
        assert sorted(got.select("id", name).collect()) == sorted(own.select("id", "v").collect(), key=lambda r: r["id"]), name
