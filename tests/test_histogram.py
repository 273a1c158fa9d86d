"""Growing and mergeable histograms against a plain running one; quantile sketches against exact ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajframe.operators import histogram, stats

Q = (0.01, 0.1, 0.5, 0.9, 0.99)


class Running:
    """A vector's histograms, batch by batch."""

    def __init__(self, bins):
        self.bins, self.lo = bins, None

    def see(self, x):
        lo, hi = x.min(0), x.max(0)
        if self.lo is None:
            self.lo, self.hi = lo, hi
            self.edges = [np.linspace(a - 1e-10, b + 1e-10, self.bins + 1) for a, b in zip(lo, hi, strict=True)]
            self.counts = [np.zeros(self.bins) for _ in lo]
        elif (lo < self.lo).any() or (hi > self.hi).any():
            self.lo, self.hi = np.minimum(lo, self.lo), np.maximum(hi, self.hi)
            for d, (a, b) in enumerate(zip(self.lo, self.hi, strict=True)):
                pad = (b - a) * 1e-10
                new, centres = np.linspace(a - pad, b + pad, self.bins + 1), (self.edges[d][:-1] + self.edges[d][1:]) / 2
                moved = np.zeros(self.bins)
                for c, n in zip(centres, self.counts[d], strict=True):
                    moved[min(max(np.searchsorted(new, c) - 1, 0), self.bins - 1)] += n
                self.edges[d], self.counts[d] = new, moved
        for d in range(x.shape[1]):
            self.counts[d] += np.histogram(x[:, d], bins=self.edges[d])[0]

    def quantile(self, d, q):
        cum, e = np.cumsum(self.counts[d]), self.edges[d]
        need = q * cum[-1]
        i = int(np.searchsorted(cum, need))
        return e[0] if i == 0 else e[i] + (need - cum[i - 1]) / (cum[i] - cum[i - 1]) * (e[i + 1] - e[i])


def batches_of(seed, n=12):
    rng = np.random.default_rng(seed)
    return [rng.normal(k % 4, 1 + k / 3, (int(rng.integers(1, 60)), 3)).round(1) for k in range(n)]


def table(spark, batches):
    rows = [("f", d, k, float(v)) for k, x in enumerate(batches) for r in x for d, v in enumerate(r)]
    return spark.createDataFrame([*rows, ("f", 0, 3, None), ("f", 1, 3, float("nan"))], "feature string, dim int, batch int, v double")


@pytest.mark.parametrize("bins", [7, 500])
def test_growth_equals_a_running_histogram(spark, bins):
    """Values on edges, a dimension that stays while another grows, nulls and NaN."""
    batches = batches_of(bins)
    model = Running(bins)
    for x in batches:
        model.see(x)
    got = histogram.grown_histograms(table(spark, batches), "feature", "dim", "batch", "v", bins).cache()
    for r in got.collect():
        assert r["counts"] == model.counts[r["dim"]].astype(int).tolist() and r["n"] == sum(map(len, batches))
        assert (r["lo"], r["hi"]) == (model.edges[r["dim"]][0], model.edges[r["dim"]][-1])
    for r in histogram.quantiles_of(got, ["feature", "dim"], Q).collect():
        assert abs(r["value"] - model.quantile(r["dim"], r["quantile"])) < 1e-9


def test_merge_in_any_order(spark):
    """Histograms of parts merged at once or in two steps: all values are there, quantiles within a bin of the exact ones."""
    batches, bins = batches_of(3), 400
    rows = table(spark, batches)
    parts = histogram.batch_histograms(rows, ["feature", "dim", "batch"], "v", bins).cache()
    for r in parts.where("batch = 5").collect():
        assert r["counts"] == np.histogram(batches[5][:, r["dim"]], bins=np.linspace(r["lo"], r["hi"], bins + 1))[0].tolist()
    once = histogram.merge_histograms(parts, ["feature", "dim"], bins)
    steps = histogram.merge_histograms(histogram.merge_histograms(parts.withColumn("half", F.col("batch") % 2), ["feature", "dim", "half"], bins), ["feature", "dim"], bins)
    for merged in (once, steps):
        values = np.concatenate(batches)
        for r in merged.collect():
            assert r["n"] == len(values) and abs(r["lo"] - values[:, r["dim"]].min()) < 1e-6
        for r in histogram.quantiles_of(merged, ["feature", "dim"], Q).collect():
            x = np.sort(values[:, r["dim"]])
            assert abs(r["value"] - x[max(int(np.ceil(r["quantile"] * len(x))) - 1, 0)]) < 4 * (x[-1] - x[0]) / bins + 0.1
    assert histogram.merge_histograms(parts.limit(0), ["feature"], bins).count() == 0


def test_sketches_merge(spark):
    """Sketches of episodes merged: every quantile's rank is near; where quantiles of episodes are averaged, it isn't."""
    rng = np.random.default_rng(0)
    rows = [(e, float(x)) for e in range(40) for x in rng.normal(e, 0.1, 200 if e else 4000)]
    frames = spark.createDataFrame(rows, "episode_index long, v double")
    merged = stats.merge_sketches(stats.episode_sketches(frames, ["v"]))
    values = np.sort([x for _, x in rows])
    found = stats.sketch_quantiles(merged, Q).first()
    assert found["count"] == len(values)
    off = {q: abs(np.searchsorted(values, found[stats.quantile_key(q)], "right") / len(values) - q) for q in Q}
    assert max(off.values()) < 0.03
    averaged = stats.merge_stats(stats.per_episode_stats(frames, ["v"])).first()
    assert abs(np.searchsorted(values, averaged["q50"]) / len(values) - 0.5) > 0.05


def test_merged_parts_equal_merged_histograms(spark):
    """Many parts with few values each: the same histogram as that of the parts' full ones, and those have all bins."""
    rows = spark.range(400).select((F.col("id") % 40).alias("part"), F.lit("a").alias("feature"), (F.col("id") * 7919 % 1009 / 3).alias("v"))
    parts = histogram.batch_histograms(rows, ["part", "feature"], "v", 50)
    assert all(len(r["counts"]) == 50 and sum(r["counts"]) == r["n"] == 10 for r in parts.collect())
    merged = histogram.merged_parts(rows, ["part"], ["feature"], "v", 50)
    assert merged.collect() == histogram.merge_histograms(parts, ["feature"], 50).collect()
    assert "map_from_entries" not in parts._jdf.queryExecution().analyzed().toString()
