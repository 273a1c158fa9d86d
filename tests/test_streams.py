"""State that leaves without end marks, and bounds on what waits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trajframe.streaming import operators as S
from trajframe.streaming import stateful as T
from trajframe.streaming.storage import new_folder

FRAMES = "episode_index long, frame_index long, v double, e boolean, b long, sec long, part long, is_last boolean"
SILENT = {"time": "ts", "silence_ms": 50_000, "delay": "5 seconds"}


def frames_of(spark, seed):
    """Three episodes whose rows come in three parts, 10 s each, and at last a row of another source long after. No row is marked as the last."""
    r = random.Random(seed)
    rows = [(e, i, float(r.randint(0, 99)), r.random() < 0.15, r.randint(1, 9), 100 + i, i // 10, False) for e in range(3) for i in range(30 - 10 * (e == 1))]
    return rows, spark.createDataFrame([*rows, (-1, 0, 0.0, False, 0, 1000, 3, False)], FRAMES).withColumn("ts", F.timestamp_seconds("sec"))


def run(spark, df, transform):
    T.use_state_store(spark)
    out, progress = S.run_stream(spark, df, "part", transform, new_folder(spark))
    return out.where("episode_index >= 0"), progress


def test_silent_episodes_are_closed(spark):
    """All rows have their windows, the last ones padded, and nothing but the last source's state is left."""
    rows, df = frames_of(spark, 1)
    out, progress = run(spark, df, lambda s: T.look_around(s, "v", 3, 2, **SILENT))
    got = {(x[0], x[1]): tuple(x)[2:] for x in out.collect()}
    want = {}
    for e in range(3):
        v = [x[2] for x in rows if x[0] == e]
        for i in range(len(v)):
            want[e, i] = (v[max(i - 3, 0)], v[min(i + 2, len(v) - 1)], i < 3, i + 2 >= len(v))
    assert got == want
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert max(held) >= 3 * held[-1] and held[-1] <= 5


def test_end_marks_close_at_once(spark):
    _, df = frames_of(spark, 2)
    marked = df.where("episode_index >= 0").withColumn("is_last", (F.col("sec") == 129) | ((F.col("episode_index") == 1) & (F.col("sec") == 119)))
    out, progress = run(spark, marked, lambda s: T.record(s, 10.0, order="sec", end="is_last", **SILENT))
    assert out.where("frame_index >= 0").count() == 80
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize(("seconds", "most"), [(6.0, None), (100.0, 20), (6.0, 12), (100.0, 1)])
def test_pre_roll_is_bounded(spark, seconds, most):
    rows, df = frames_of(spark, 3)
    out, _ = run(spark, df, lambda s: T.pre_roll(s, "e", "sec", seconds, size="b", max_bytes=most, **SILENT))
    want = set()
    for e in range(3):
        waiting, saving = [], False
        for _, i, _, event, b, t, _, _ in (x for x in rows if x[0] == e):
            if event and not saving:
                want |= {(e, x[0]) for x in waiting if t - x[2] <= seconds} | {(e, i)}
                waiting, saving = [], True
            elif saving:
                want.add((e, i))
                saving = not event
            else:
                waiting.append((i, b, t))
                while len(waiting) > 1 and (t - waiting[0][2] > seconds or (most is not None and sum(x[1] for x in waiting) > most)):
                    waiting.pop(0)
    assert {tuple(x) for x in out.collect()} == want


def test_gate_state_times_out(spark):
    """The gate and the queue of actions drop silent episodes as well."""
    _, df = frames_of(spark, 4)
    _, progress = run(spark, df, lambda s: S.similarity_gate(s, ["v"], 5.0, **SILENT))
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the last source's
    _, progress = run(spark, df, lambda s: S.late_actions(s.withColumn("target", F.col("frame_index") + 2), value="v", executed="frame_index", **SILENT))
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert T.observed(progress, "actions", "late") == 0 and T.observed(progress, "actions", "queued") == 81


def test_replays_are_dropped_and_counted(spark):
    _, df = frames_of(spark, 5)
    twice = df.unionByName(df.where("frame_index % 4 = 0").withColumn("part", F.col("part")))
    out, progress = run(spark, twice, lambda s: T.without_replays(s, ["episode_index", "frame_index"], "ts", "1 hour"))
    n = df.where("episode_index >= 0").count()
    assert out.count() == n and T.dropped_replays(progress) == twice.count() - n - 1


def test_rows_of_an_episode_reach_python_together(spark):
    rows = spark.range(3000).coalesce(1).select((F.col("id") % 3).alias("e"), F.col("id").alias("o"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") != 4, F.col("id")).alias("v"))
    got = {r["__key"]: r for r in T._packed(rows, ["v"], "e", "o", None, "ts").collect()}
    assert len(got) == 3 and got[2]["__at"] == 2_999_000 and not got[2]["__last"]
    assert got[1]["__order"] == list(range(1, 3000, 3)) and got[1]["__value0"] == [1, None, *range(7, 3000, 3)]


def test_a_timer_is_set_anew_for_an_episode_that_goes_on(spark):
    """Each part comes before the silence since the last one is over, but after the first part's timer has expired."""
    rows = [(0, 10 * p + i, 100 + 40 * p + i, p) for p in range(5) for i in range(10)] + [(-1, 0, 1000, 5)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, sec long, part long").withColumn("ts", F.timestamp_seconds("sec"))
    out, progress = run(spark, df, lambda s: T.record(s, 1.0, order="sec", **SILENT))
    assert [x[0] for x in out.orderBy("sec").select("frame_index").collect()] == list(range(50))
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
