"""Appending, resuming, conflicts and lost writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trajframe.sources.appendable import Appendable, Taken
from trajframe.sources.dataset import integrity, modified
from trajframe.streaming.storage import new_folder

FEATURES = {"v": {"dtype": "float64", "shape": [1]}, "note": {"dtype": "string", "shape": [1]}}


def batch(spark, first, lengths, task):
    rows = [(first + e, i, float(10 * e + i), f"n{i}", f"{task}{e % 2}") for e, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "episode_index long, at long, v double, note string, task string")


@pytest.fixture()
def store(spark):
    return Appendable.create(spark, f"{new_folder(spark)}/data", 10, FEATURES, file_bytes=100, files_per_chunk=2, robot_type="arm")


def test_append_and_resume(spark, store):
    """Two batches by two handles: numbers go on, a batch begins a new file, known tasks keep their ids, a batch isn't appended twice."""
    a = store.append(batch(spark, 7, [3, 5, 2], "a"), "one", ["at"], frame_bytes=20)
    assert (a.version, a.episodes, a.frames, a.files, a.next_task) == (1, 3, 10, 3, 2)  # 60 + 100, 100 + 40 reach the bound
    again = Appendable(spark, store.root)
    b = again.append(batch(spark, 0, [1, 2, 4], "a").union(batch(spark, 3, [1], "b")), "two", ["at"], frame_bytes=20)
    assert (b.version, b.next_episode, b.next_index, b.next_file, b.next_task) == (2, 7, 18, 6, 3)
    assert again.append(batch(spark, 0, [9], "c"), "two", ["at"]) == b and store.append(batch(spark, 0, [9], "c"), "one", ["at"]) == a
    whole = store.read()
    rows = whole.frames.join(whole.tasks, "task_index").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(18))
    assert [(r["episode_index"], r["frame_index"]) for r in rows] == [(e, i) for e, n in enumerate([3, 5, 2, 1, 2, 4, 1]) for i in range(n)]
    assert [r["task"] for r in rows] == ["a0"] * 3 + ["a1"] * 5 + ["a0"] * 2 + ["a0"] + ["a1"] * 2 + ["a0"] * 4 + ["b0"]
    assert [round(r["timestamp"], 3) for r in rows[:3]] == [0.0, 0.1, 0.2] and [r["note"] for r in rows[:3]] == ["n0", "n1", "n2"]
    files = [(r["chunk_index"], r["file_index"]) for r in whole.episodes.orderBy("episode_index").collect()]
    assert files == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (2, 0), (2, 1)]  # the third file of the first batch isn't filled up
    assert whole.info.total_frames == 18 and whole.info.total_episodes == 7 and whole.info.splits == {"train": "0:7"}
    assert integrity(whole.frames.withColumnRenamed("index", "idx"), whole.episodes).where("NOT (length_ok AND bounds_ok AND dense_ok)").count() == 0
    s = whole.stats.where("feature = 'v'").first()
    want = [10.0 * e + i for e, n in ((0, 3), (1, 5), (2, 2), (0, 1), (1, 2), (2, 4), (0, 1)) for i in range(n)]
    assert s["count"] == 18 and s["min"] == min(want) and s["max"] == max(want) and abs(s["mean"] - sum(want) / 18) < 1e-9
    old = store.read(1)
    assert old.frames.count() == 10 and old.info.total_tasks == 2
    # Every number is one file on disk.
    names = whole.frames.select(F.input_file_name().alias("f")).distinct().count()
    assert names == a.files + b.files == 6


def test_lost_writer_leaves_nothing(spark, store):
    """Killed between stage and commit: readers see nothing of it, the batch can come again, and its folder can be swept."""
    store.append(batch(spark, 0, [2], "a"), "one", ["at"])
    lost = store.stage(batch(spark, 0, [4], "a"), "two", ["at"])
    assert store.read().frames.count() == 2 and [c.batch for c in store.log()] == ["one"]
    done = store.append(batch(spark, 0, [4], "a"), "two", ["at"])
    assert (done.next_index, done.folder != lost.folder) == (6, True)
    assert store.sweep() == [lost.folder] and store.read().frames.count() == 6
    with pytest.raises(Taken):
        store.commit(lost)


def test_slower_writer_goes_behind(spark, store, monkeypatch):
    """Another writer commits while a batch is staged: it is staged anew with the numbers behind that one."""
    other, stage, calls = Appendable(spark, store.root), store.stage, []

    def slow(*args):
        out = stage(*args)
        if not calls:
            other.append(batch(spark, 0, [5], "x"), "fast", ["at"])
        calls.append(out)
        return out

    monkeypatch.setattr(store, "stage", slow)
    done = store.append(batch(spark, 0, [3], "a"), "slow", ["at"])
    assert len(calls) == 2 and (done.version, done.next_index) == (2, 8)
    got = [(r["episode_index"], r["index"]) for r in store.read().frames.orderBy("index").collect()]
    assert got == [(0, i) for i in range(5)] + [(1, i) for i in range(5, 8)]


def test_what_does_not_fit_is_refused(spark, store):
    bad = spark.createDataFrame([(0, 0, 1.0)], "episode_index long, at long, v float")
    assert store.mismatches(bad, robot_type="leg", fps=30) == ["note is missing", "task is missing", "v is float, not double", "robot_type is leg, not arm", "fps is 30, not 10"]
    with pytest.raises(ValueError, match="note is missing; task is missing"):
        store.append(bad, "one", ["at"])
    with pytest.raises(ValueError, match="there is a dataset"):
        Appendable.create(spark, store.root, 10, FEATURES)
    with pytest.raises(ValueError, match="nothing is committed"):
        store.read()
    none = store.append(batch(spark, 0, [2], "a").limit(0), "none", ["at"])
    assert (none.frames, none.next_file) == (0, 0)
    store.append(batch(spark, 0, [2], "a"), "some", ["at"])
    assert store.read().frames.count() == 2


def test_edits_take_the_stats_along(spark, store):
    """A removed feature leaves neither a column nor a spec nor stats; an added number gets all three."""
    store.append(batch(spark, 0, [2, 3], "a"), "one", ["at"])
    data = modified(store.read(), {"w": (F.col("v") * 2, {"dtype": "float64", "shape": [1]})}, ["v"])
    assert "v" not in data.frames.columns and "v" not in data.info.features and data.info.features["w"]["dtype"] == "float64"
    s = data.stats.collect()
    assert [r["feature"] for r in s] == ["w"] and (s[0]["count"], s[0]["min"], s[0]["max"]) == (5, 0.0, 24.0)
    assert "v" in store.read().info.features
