"""Histograms of equal bins that can be merged and whose range can grow.

A histogram is a row (keys..., lo, hi, n, counts): ``counts`` has the number of values in each of equal bins over [lo, hi], the last one closed. If the range grows,
counts move to the bin of their old centre. Two ways lead there:

* ``merge_histograms`` takes histograms of any parts (episodes, micro-batches, shards) in any order: the range is that of all, and each part's counts move once.
* ``grown_histograms`` does what a running histogram does that sees numbered batches one after another, with a move at each growth. Nothing is run batch by batch for it:
  the running minimum and maximum say which batches grow the range and so the edges that hold at each batch, values are binned on the edges of their
  batch in one pass, and only the counts (a row for each edge set and bin) are moved on in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.operators.stats import QUANTILES

BINS = 5000
#: What a first range is widened by, and what part of its width a grown one is.
PAD, GROWN_PAD = 1e-10, 1e-10


def edge(lo: Column, hi: Column, bins: int, i: Column) -> Column:
    """The i-th of bins + 1 edges; the last one is ``hi`` itself."""
    return F.when(i == bins, hi).otherwise(i * ((hi - lo) / bins) + lo)


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin whose left edge is at most, and whose right edge is above the value; division alone may be off by one at an edge."""
    near = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - lo) / ((hi - lo) / bins)))).cast("int")
    down = (near > 0) & (v < edge(lo, hi, bins, near))
    up = (near < bins - 1) & (v >= edge(lo, hi, bins, near + 1))
    return near - down.cast("int") + up.cast("int")


def moved_bin(centre: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin whose left edge is below, and whose right edge is at least the old centre."""
    near = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((centre - lo) / ((hi - lo) / bins)) - 1)).cast("int")
    down = (near > 0) & (centre <= edge(lo, hi, bins, near))
    up = (near < bins - 1) & (centre > edge(lo, hi, bins, near + 1))
    return near - down.cast("int") + up.cast("int")


def _dense(counted: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Histograms from (keys, lo, hi, bin, c): at most ``bins`` rows for each. In one pass over the present bins, each behind the zeros that part it from the last one."""
    found = counted.groupBy(*keys, "lo", "hi").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("__s"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    last = lambda i: F.coalesce(F.get("__s", i - 1)["bin"], F.lit(-1))
    full = F.flatten(F.transform("__s", lambda x, i: F.concat(zeros(x["bin"] - last(i) - 1), F.array(x["c"]))))
    return found.select(*keys, "lo", "hi", "n", F.concat(full, zeros(F.lit(bins - 1) - last(F.size("__s")))).alias("counts"))


def batch_histograms(rows: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """A histogram for each key over its own range; nulls and NaN aren't counted."""
    return _dense(_counted(rows, keys, value, bins), keys, bins)


def _counted(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, lo, hi, bin, c) of the bins that have values."""
    v = rows.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__v")).where("__v IS NOT NULL")
    ranges = v.groupBy(*keys).agg((F.min("__v") - PAD).alias("lo"), (F.max("__v") + PAD).alias("hi"))
    binned = v.join(ranges, keys).select(*keys, "lo", "hi", bin_of(F.col("__v"), F.col("lo"), F.col("hi"), bins).alias("bin"))
    return binned.groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"))


def merge_histograms(parts: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """One histogram for each key over the range of all its parts. Parts may have other numbers of bins; they are summed by bin before a histogram is put together."""
    ranges = parts.groupBy(*keys).agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    own = parts.select(*keys, "lo", "hi", F.size("counts").alias("__bins"), F.posexplode("counts").alias("__i", "c")).where("c > 0").join(ranges, keys)
    return _merged(own, keys, bins)


def merged_parts(rows: DataFrame, part: list[str], keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """The same as the histograms of all (part, keys) merged to one for each key, but only bins that have values are ever held: many small parts have far fewer values than bins."""
    counted = _counted(rows, [*part, *keys], value, bins)
    v = rows.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__v")).where("__v IS NOT NULL")
    ranges = v.groupBy(*keys).agg((F.min("__v") - PAD).alias("__lo"), (F.max("__v") + PAD).alias("__hi"))
    own = counted.select(*keys, "lo", "hi", F.lit(bins).alias("__bins"), F.col("bin").alias("__i"), "c").join(ranges, keys)
    return _merged(own, keys, bins)


def _merged(own: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Histograms over [__lo, __hi] from counts (keys, lo, hi, __bins, __i, c, __lo, __hi), each at the centre of its own bin."""
    left, right = (F.col("lo") + (F.col("__i") + k) * ((F.col("hi") - F.col("lo")) / F.col("__bins")) for k in (0, 1))
    at = moved_bin((left + right) / 2, F.col("__lo"), F.col("__hi"), bins)
    moved = own.select(*keys, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), at.alias("bin"), "c")
    return _dense(moved.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("c").alias("c")), keys, bins)


def edge_sets(rows: DataFrame, feature: str, dim: str, batch: str, value: str) -> DataFrame:
    """(feature, dim, batch, turn, lo, hi): the edges that hold once a batch has been seen; ``turn`` counts the growths so far. A feature's dimensions grow together.

    The windows have a row for each batch of a feature."""
    seen = rows.groupBy(feature, dim, batch).agg(F.min(value).alias("__min"), F.max(value).alias("__max"))
    so_far = Window.partitionBy(feature, dim).orderBy(batch)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    ran = seen.select(feature, dim, batch, *(f(c).over(w).alias(n) for f, c, w, n in ((F.min, "__min", so_far, "min"), (F.max, "__max", so_far, "max"), (F.min, "__min", before, "min0"), (F.max, "__max", before, "max0"))))
    grown = ran.groupBy(feature, batch).agg(F.max(F.coalesce(((F.col("min") < F.col("min0")) | (F.col("max") > F.col("max0"))).cast("int"), F.lit(0))).alias("__g"))
    turns = grown.select(feature, batch, F.sum("__g").over(Window.partitionBy(feature).orderBy(batch)).alias("turn"))
    at = ran.join(turns, [feature, batch])
    first = F.min_by(F.struct("min", "max"), batch).over(Window.partitionBy(feature, dim, "turn"))
    pad = F.when(F.col("turn") == 0, F.lit(PAD)).otherwise((F.col("__f.max") - F.col("__f.min")) * GROWN_PAD)
    return at.withColumn("__f", first).select(feature, dim, batch, "turn", (F.col("__f.min") - pad).alias("lo"), (F.col("__f.max") + pad).alias("hi"))


def grown_histograms(rows: DataFrame, feature: str, dim: str, batch: str, value: str, bins: int = BINS) -> DataFrame:
    """(feature, dim, lo, hi, n, counts) of a running histogram over batches in rising order."""
    v = rows.select(feature, dim, batch, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__v")).where("__v IS NOT NULL")
    sets = edge_sets(v, feature, dim, batch, "__v")
    binned = v.join(sets, [feature, dim, batch])
    counted = binned.groupBy(feature, dim, "turn", "lo", "hi", bin_of(F.col("__v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    kinds = dict(counted.dtypes)

    def work(batches):
        """Rows come by feature, dim and turn; only the present counts are held."""
        key, turn, lo, hi, counts, done = None, None, 0.0, 0.0, np.zeros(bins, np.int64), []
        schema = None

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
            done.clear()
            return out

        for b in batches:
            schema = schema or pa.schema([b.schema.field(0), b.schema.field(1), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("counts", pa.list_(pa.int64()))])
            for f, d, t, left, right, at, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (f, d) != key:
                    if key is not None:
                        done.append((*key, lo, hi, int(counts.sum()), counts.tolist()))
                    key, counts = (f, d), np.zeros(bins, np.int64)
                elif t != turn:
                    old, new = np.linspace(lo, hi, bins + 1), np.linspace(left, right, bins + 1)
                    place = np.clip(np.searchsorted(new, (old[:-1] + old[1:]) / 2) - 1, 0, bins - 1)
                    counts = np.bincount(place, counts, minlength=bins).astype(np.int64)
                turn, lo, hi = t, left, right
                counts[at] += c
            if done:
                yield sent()
        if key is not None:
            done.append((*key, lo, hi, int(counts.sum()), counts.tolist()))
            yield sent()

    dealt = counted.repartition(feature, dim).sortWithinPartitions(feature, dim, "turn").select(feature, dim, "turn", "lo", "hi", "bin", "c")
    return dealt.mapInArrow(work, f"{feature} {kinds[feature]}, {dim} {kinds[dim]}, lo double, hi double, n long, counts array<long>")


def quantiles_of(histograms: DataFrame, keys: list[str], quantiles=QUANTILES) -> DataFrame:
    """(keys, quantile, value): linear inside the bin where the running count first reaches q n; the left end in the first bin."""
    bins = F.size("counts")
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = histograms.select(*keys, "lo", "hi", "n", bins.alias("__bins"), F.posexplode("counts").alias("bin", "c")).where("c > 0")
    rows = rows.withColumn("cum", F.sum("c").over(w)).withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    need, before = F.col("q") * F.col("n"), F.col("cum") - F.col("c")
    hit = rows.where((F.col("cum") >= need) & (before < need))
    step = (F.col("hi") - F.col("lo")) / F.col("__bins")
    left, right = F.col("bin") * step + F.col("lo"), F.when(F.col("bin") + 1 == F.col("__bins"), F.col("hi")).otherwise((F.col("bin") + 1) * step + F.col("lo"))
    value = F.when(F.col("bin") == 0, F.col("lo")).otherwise(left + (need - before) / F.col("c") * (right - left))
    return hit.select(*keys, F.col("q").alias("quantile"), value.alias("value"))
