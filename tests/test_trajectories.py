"""Operators on tiny tables with values worked out by hand, and plans."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajframe.functions import kinematics, vectors
from trajframe.operators import align, edit, evaluate, numbering, packing, progress, sampling, stats, windows
from trajframe.operators.pipeline import Pipeline
from trajframe.sources import dataset


@pytest.fixture()
def frames(spark):
    rows = [(e, f, float(10 * e + f), n) for e, n in ((0, 2), (1, 1), (2, 3)) for f in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, v double, length long")


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sample_sizes(spark):
    lengths = [1, 10, 100, 200, 1000, 2000, 5000, 10000, 20000, 50000, 500000]
    want = [1, 10, 100, 100, 177, 299, 594, 1000, 1681, 3343, 10000]
    df = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", sampling.sample_size(F.col("n")).alias("k"))
    assert [r["k"] for r in df.orderBy("n").collect()] == want


def test_evenly_spaced_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0, 6)], "episode_index long, length long")
    got = rows_of(sampling.evenly_spaced(df, least=3, most=3), "frame_index")
    assert got == [(0, round(x)) for x in np.linspace(0, 5, 3)]


def test_merge_stats(spark):
    parts = spark.createDataFrame([("a", 1, 1.0, 9.0, 5.0, 2.0, 4.0), ("a", 1, 2.0, 12.0, 6.0, 2.5, 6.0)], "feature string, count long, min double, max double, mean double, std double, q50 double")
    got = stats.merge_stats(parts).first()
    assert (got["count"], got["min"], got["max"], got["mean"], got["q50"]) == (2, 1.0, 12.0, 5.5, 5.0)
    assert got["std"] == pytest.approx(2.318405, abs=1e-6)


def test_merged_quantile_needs_every_part(spark):
    parts = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, 0.0, 1.0), ("a", 1, 1.0, 1.0, 1.0, 0.0, None)], "feature string, count long, min double, max double, mean double, std double, q50 double")
    assert stats.merge_stats(parts).first()["q50"] is None


def test_quantile_key_truncates():
    assert [stats.quantile_key(q) for q in (0.01, 0.5, 0.29)] == ["q01", "q50", "q28"]


def test_episode_sampler(frames):
    index = frames.withColumn("i", F.col("frame_index") + F.when(F.col("episode_index") == 0, 0).when(F.col("episode_index") == 1, 2).otherwise(3))
    ids = lambda **k: [r["i"] for r in sampling.episode_sampler(index, **k).orderBy("i").collect()]
    assert ids(drop_first=1) == [1, 4, 5]
    assert ids(drop_last=1) == [0, 3, 4]
    assert ids(episodes=[0, 2]) == [0, 1, 3, 4, 5]


def test_two_kinds_of_padding(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(6)], "episode_index long, frame_index long, v double")
    clamp = windows.delta_window(df, "v", [-1, -5]).where("frame_index = 3").first()
    near = windows.delta_window(df, "v", [-1, -5], "nearest_success").where("frame_index = 3").first()
    assert clamp["v_window"] == [2.0, 0.0] and near["v_window"] == [2.0, 2.0]
    assert clamp["v_window_is_pad"] == near["v_window_is_pad"] == [False, True]
    with pytest.raises(ValueError):
        windows.delta_window(df, "v", [1], "other")


def test_window_forms_agree(frames):
    by_join = {(r[0], r[1], r[2]): (r[3], r[4]) for r in windows.delta_window_by_join(frames, "v", [-2, 1]).collect()}
    for r in windows.delta_window(frames, "v", [-2, 1]).collect():
        for i, d in enumerate((-2, 1)):
            assert by_join[r["episode_index"], r["frame_index"], d] == (r["v_window"][i], r["v_window_is_pad"][i])


def test_gradient_and_unwrap_match_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.1, 1, 20))
    x = rng.normal(size=20)
    a = np.cumsum(rng.uniform(-3, 3, 20)) % (2 * math.pi)
    df = spark.createDataFrame([(0, i, float(p), float(q), float(r)) for i, (p, q, r) in enumerate(zip(t, x, a))], "episode_index long, frame_index long, t double, x double, a double")
    got = windows.unwrap(df.withColumn("g", windows.gradient(F.col("x"), F.col("t"))), "a", "u").orderBy("frame_index").collect()
    assert np.allclose([r["g"] for r in got], np.gradient(x, t, edge_order=2))
    assert np.allclose([r["u"] for r in got], np.unwrap(a))


def test_short_episodes_have_no_gradient(frames):
    got = frames.withColumn("g", windows.gradient(F.col("v"), F.col("frame_index").cast("double"))).where("length < 3")
    assert [r["g"] for r in got.collect()] == [None] * 3


def test_renumber_and_delete(frames):
    got = rows_of(edit.delete_episodes(frames, [1]).select("new_episode_index", "frame_index", "new_index"), "new_index")
    assert got == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3), (1, 2, 4)]
    for wrong in ([], [0, 1, 2]):
        with pytest.raises(ValueError):
            edit.delete_episodes(frames, wrong)


def test_offsets_over_many_buckets(spark):
    n = 3 * numbering.BUCKET + 5
    df = spark.range(n).select(F.col("id").alias("episode_index"), (F.col("id") % 3 + 1).alias("length"))
    got = numbering.cumulative_offsets(df, "length", "episode_index", "a", "b").orderBy("episode_index").collect()
    ends = np.cumsum([i % 3 + 1 for i in range(n)])
    assert [r["b"] for r in got] == ends.tolist() and all(r["b"] - r["a"] == r["length"] for r in got)


def test_packing(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([4.0, 4.0, 4.0, 9.0, 1.0])], "dataset string, episode_index long, size double")
    got = rows_of(packing.pack_files(df, 9.0, files_per_chunk=2), "episode_index")
    assert [(r[2], r[3]) for r in got] == [(0, 0), (0, 0), (0, 1), (1, 0), (1, 1)]


def test_splits(spark):
    df = spark.range(10).withColumnRenamed("id", "episode_index")
    got = {r[0]: r[1] for r in edit.split_by_fraction(df, {"a": 0.55, "b": 0.0, "c": 0.2}).collect()}
    assert [got[i] for i in range(10)] == ["a"] * 5 + ["c"] * 5
    for wrong in ({"a": 0.9, "b": 0.2},):
        with pytest.raises(ValueError):
            edit.split_by_fraction(df, wrong)
    with pytest.raises(ValueError):
        edit.split_by_lists(df, {"a": [1], "b": [1]})
    assert [r[0] for r in rows_of(edit.hold_out(df, 0.15).select("episode_index"), "episode_index")] == [8, 9]


def test_features(frames):
    out = edit.modify_features(frames, {"w": F.col("v") * 2}, ["v"])
    assert out.columns == ["episode_index", "frame_index", "length", "w"]
    for add, gone in (({"v": F.lit(1)}, []), ({}, ["frame_index"]), ({}, ["nothing"])):
        with pytest.raises(ValueError):
            edit.modify_features(frames, add, gone)


def test_asof_family(spark):
    left = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.5, 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0)], "k string, t double, v double")
    get = lambda df: [r["v"] for r in df.orderBy("t").collect()]
    assert get(align.asof(left, right, "k", "t", ["v"])) == [None, 10.0, 10.0, 20.0]
    assert get(align.asof(left, right, "k", "t", ["v"], clip=True)) == [10.0, 10.0, 10.0, 20.0]
    assert get(align.asof(left, right, "k", "t", ["v"], "forward")) == [10.0, 10.0, 20.0, None]
    assert get(align.asof(left, right, "k", "t", ["v"], "nearest")) == [10.0, 10.0, 10.0, 20.0]
    assert get(align.interpolate(left, right, "k", "t", ["v"])) == [10.0, 10.0, 15.0, 20.0]
    near = align.asof(left, right, "k", "t", ["v"], "nearest", 0.6).orderBy("t").collect()
    assert [r["within_tol"] for r in near] == [False, True, True, False]


def test_stages(spark):
    f = spark.range(12).select(F.lit(0).cast("long").alias("episode_index"), F.col("id").alias("frame_index"))
    iv = spark.createDataFrame([(0, 0, 1, 3), (0, 1, 6, 10)], "episode_index long, pos int, start long, end long")
    got = [r["stage"] for r in progress.stage_and_tau(f, iv).orderBy("frame_index").collect()]
    assert got == pytest.approx([0, 0, 0.5, 1, 1, 1, 1, 1.25, 1.5, 1.75, 1.999, 1.999])


def test_proportions(spark):
    iv = spark.createDataFrame([(0, 0, "a", 0, 2), (0, 1, "b", 2, 8), (1, 0, "a", 0, 5), (1, 1, "b", 5, 10)], "episode_index long, pos int, name string, start long, end long")
    got = {r[0]: r[1] for r in progress.proportions(iv).collect()}
    assert got == pytest.approx({"a": 0.375, "b": 0.625})


def test_breakpoints_end_at_one():
    assert progress.breakpoints([0.1, 0.2, 0.7])[-1] == 1.0


def test_unknown_strategy(frames):
    with pytest.raises(ValueError):
        progress.weigh(frames, "none")


def test_joint_mask():
    assert vectors.joint_mask(["Shoulder_Pan", "gripper.pos", "x"], ["GRIPPER"]) == [True, False, True]


def test_normalise_round_trip(frames):
    s = {"mean": [1.0], "std": [2.0], "min": [0.0], "max": [0.0], "q01": [0.0], "q99": [10.0]}
    for mode in ("mean_std", "min_max", "quantiles", "identity"):
        z = vectors.normalise(F.array("v"), mode, s)
        back = vectors.normalise(z, mode, s, inverse=True)
        for r in frames.select("v", F.get(back, F.lit(0)).alias("b")).collect():
            assert r["b"] == pytest.approx(r["v"], abs=1e-6)
    with pytest.raises(ValueError):
        vectors.normalise(F.array("v"), "quantile10", s)


def test_rotations(spark):
    df = spark.createDataFrame([([0.0, 0.0, math.pi / 2],), ([0.0, 0.0, 0.0],), ([1e-9, 0.0, 0.0],)], "r array<double>")
    q = vectors.rotvec_to_quaternion(F.col("r"))
    got = df.select(vectors.quaternion_to_rotvec(q).alias("b"), "r", vectors.rotate(q, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("x")).collect()
    for r in got:
        assert r["b"] == pytest.approx(r["r"], abs=1e-12)
    assert got[0]["x"] == pytest.approx([0, 1, 0], abs=1e-12)


def test_forward_kinematics(spark):
    pose = kinematics.forward_kinematics([{"a": 1.0, "alpha": 0.0, "d": 0.0, "theta_offset": 0.0}] * 2)
    df = spark.createDataFrame([([90.0, -90.0],), (None,), ([1.0],)], "q array<double>")
    got = [r[0] for r in df.select(pose("q")).collect()]
    assert got[0] == pytest.approx([1, 1, 0, 0, 0, 0], abs=1e-12) and got[1:] == [None, None]


def test_tails():
    assert evaluate.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert evaluate.f_tail(4.0, 2, 10) == pytest.approx(1.8**-5)  # (1 + d1 f / d2)^(-d2 / 2) for d1 = 2
    assert evaluate.fisher_tail(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "feature string, p double")
    got = {r["feature"]: r["p_fdr"] for r in evaluate.false_discovery(df).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.5})


def test_step_pipeline(frames):
    p = Pipeline([("filter", {"condition": "v > 0"}), ("rename", {"names": {"v": "w"}})])
    assert [n for n, _ in p.stages(frames)] == ["filter", "rename"]
    assert Pipeline.from_json(p.to_json())(frames).columns == ["episode_index", "frame_index", "w", "length"]
    with pytest.raises(ValueError):
        p.with_options(other={})
    with pytest.raises(ValueError):
        Pipeline([("nothing", {})])


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(e, f, f"task{e % 2}", float(f)) for e in range(3) for f in range(4)], "episode_index long, n int, task string, speed double")
    ds = dataset.build(rows, 30, ["n"], {"speed": {"dtype": "float64", "shape": [1]}})
    ds.write(f"file://{tmp_path}/ds")
    back = dataset.Dataset.read(spark, f"file://{tmp_path}/ds", [1, 2])
    assert back.frames.count() == 8 and back.episodes.count() == 2 and back.subtasks is None
    assert [r["index"] for r in back.frames.orderBy("index").collect()] == list(range(4, 12))
    assert back.info.total_frames == 12 and back.info.splits == {"train": "0:3"}
    assert "In(episode_index" in back.frames._jdf.queryExecution().toString().replace("IN (", "In(") or "PushedFilters: [In" in back.frames._jdf.queryExecution().toString()


def test_info_checks():
    with pytest.raises(ValueError):
        dataset.Info(0, {})
    with pytest.raises(ValueError):
        dataset.Info(30, {"a/b": {}})
    with pytest.raises(ValueError):
        dataset.Info.parse('{"codebase_version": "v2.1", "fps": 30, "features": {}}')


def test_frame_violations(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([1.0], 2)], "state array<double>, extra int")
    features = {"state": {"dtype": "float64", "shape": [2]}, "gone": {"dtype": "string", "shape": [1]}}
    got = {(r["column"], r["problem"]) for r in dataset.frame_violations(df, features).collect()}
    assert ("gone", "missing column") in got and ("extra", "extra column") in got


def test_no_window_over_all_frames(spark):
    """The only windows without a partition run over tasks and buckets of episodes."""
    import __spark_entry__

    plan = __spark_entry__.queries()["e1_delta_window_clamped"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if line.lstrip("+-: ").startswith("Window") and "windowspecdefinition(" in line:
            assert "episode_index" in line or "task" in line or "__bucket" in line


def test_shards_go_on_where_they_stopped(spark):
    """A finished attempt's shards aren't run again; an attempt that was cut short counts for nothing."""
    from trajframe.operators import structure
    from trajframe.streaming.storage import new_folder

    rows = spark.createDataFrame([(e, i, float(i)) for e in range(7) for i in range(3)], "episode_index long, index long, v double")
    folder, ran = f"{new_folder(spark)}/shards", []

    def job(part):
        ran.append(sorted(r[0] for r in part.select("episode_index").distinct().collect()))
        return part.withColumn("w", F.col("v") + 1)

    structure.run_sharded(rows.where("episode_index % 3 = 2"), job, 3, folder)
    rows.where("episode_index = 0").withColumn("w", F.lit(-1.0)).withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(f"{folder}/attempt-00009")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/attempt-00009/_SUCCESS")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    out = structure.run_sharded(rows, job, 3, folder)
    assert ran == [[2, 5], [0, 1, 3, 4, 6]] and out.count() == 21 and out.where("w <> v + 1").count() == 0
    structure.run_sharded(rows, job, 3, folder)
    assert len(ran) == 2


def test_derived_tables_follow_the_files(spark, tmp_path):
    """A table that changes within a session is derived anew."""
    from trajframe.plans import views

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = f"{tmp_path}/events.parquet"
    source.where("user_id < 3").write.parquet(path)
    few = views.frames(spark, str(tmp_path)).count()
    source.where("user_id < 6").write.mode("overwrite").parquet(path)
    assert views.frames(spark, str(tmp_path)).count() == source.where("user_id < 6").count() > few


def test_kinematics_counts_steps_past_a_whole_turn_back(spark):
    """One step of 6.5 among small ones: by the angle it is 2 pi - 6.5, by the quaternions alone 6.5 - 2 pi."""
    yaws = [0.0, 0.5, 7.0, 7.5]
    rows = spark.createDataFrame([(0, i, float(i), 0.0, a) for i, a in enumerate(yaws)], "episode_index long, frame_index long, t double, p double, yaw double")
    turned = rows.withColumn("q", vectors.euler_to_quaternion(F.lit(0.0), F.lit(0.0), F.col("yaw")))
    mean = lambda *angle: evaluate.kinematics(turned, ["p"], "t", "q", *angle).first()["mean_turn"]
    assert mean("yaw") == pytest.approx((1.0 + 2 * math.pi - 6.5) / 3)
    assert mean() == pytest.approx((1.0 + 6.5 - 2 * math.pi) / 3)


def test_stage_of_episodes_without_stages(spark, frames):
    """They stay with null where asked to; their targets are null, and slots that are not filled 0."""
    iv = spark.createDataFrame([(0, 0, 0, 1)], "episode_index long, pos int, start int, end int")
    staged = progress.stage_and_tau(frames, iv, how="left")
    assert rows_of(staged.groupBy("episode_index").agg(F.count("stage"), F.count(F.lit(1))), "episode_index") == [(0, 2, 2), (1, 0, 1), (2, 0, 3)]
    got = progress.progress_targets(staged.where("episode_index = 2"), "stage", 2, 1, 1, F.lit(0)).first()
    assert (list(got["targets"]), got["rewound"]) == ([None, None, None, 0.0], 0)


def test_nearest_turn(spark):
    """Angles of more than a whole turn come back from the pose with their turns."""
    df = spark.createDataFrame([(a,) for a in (0.0, 3.0, 6.2957, 7.7266, 14.0, -7.0)], "a double")
    pose = vectors.pose_state(F.array(F.lit(0.0)), vectors.euler_to_quaternion(F.lit(0.0), F.lit(0.0), F.col("a")), F.lit(1.0))
    for r in df.select("a", vectors.nearest_turn(F.get(pose, F.lit(3)), F.col("a")).alias("b")).collect():
        assert r["b"] == pytest.approx(r["a"], abs=1e-9)


def test_forward_kinematics_half_turn(spark):
    """A second joint past the quarter turn: yaw is half a turn, -pi where the first joint is exactly 0, and by the sign of its sine elsewhere."""
    pose = kinematics.forward_kinematics([{"a": 0.0, "alpha": 90.0, "d": 0.1, "theta_offset": 0.0}, {"a": 0.3, "alpha": 0.0, "d": 0.0, "theta_offset": 0.0}])
    df = spark.createDataFrame([([0.0, 98.0],), ([0.0, 260.0],), ([360.0, 98.0],)], "v array<double>")
    assert [r["p"][3] for r in df.select(pose("v").alias("p")).collect()] == pytest.approx([-math.pi, -math.pi, math.pi])


def test_rotations_do_not_multiply_in_the_plan(spark):
    """A rotation there and back through its vector form: each value stands a few times in the plan, not thousands."""
    df = spark.range(1).select(F.array(*(F.lit(x) for x in (0.1, 0.2, 0.3, 0.9))).alias("q"), F.array(*(F.lit(x) for x in (1.0, 2.0, 3.0))).alias("v"))
    p = vectors.rotvec_to_quaternion(vectors.quaternion_to_rotvec(F.col("q")))
    back = df.select(vectors.rotate(vectors.quaternion_inverse(p), vectors.rotate(F.col("q"), F.col("v"))).alias("w"))
    assert back._jdf.queryExecution().analyzed().toString().count("lambdafunction") < 100
