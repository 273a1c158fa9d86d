"""Size-bounded packing of ordered items (episodes into files, episodes into batches) without a fold over them.

A file that began at an item ends at a place that only the running sums decide, so each item's next cut is found for all items at once: a search of the sums by
an ordered scan over ranges. Which of these cuts are real follows from the first item by pointer doubling: in round k the cuts known so far jump 2^k cuts ahead,
and the table of jumps is joined with itself. The rounds grow with the logarithm of the number of files. Nothing runs over a whole group in one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.operators.scan import next_marked, ranged, running_sums
from trajframe.streaming.storage import stored

#: Sizes are exact to six decimals; sums of binary fractions would depend on the order of adding.
EXACT = "decimal(28,6)"


def _exact(value: float) -> Column:
    return F.lit(Decimal(str(value))).cast(EXACT)


def first_reaching(items: DataFrame, group: str, before: str, own: str, targets: dict[str, tuple[Column, bool]]) -> DataFrame:
    """(group, pos, a column for each target): the first position whose running sum, with its own size, is at least the target, or above it if that is strict."""
    kind = "__kind"
    ask = lambda name, target, strict: items.select(group, "pos", target.cast("decimal(38,6)").alias("__v"), F.lit(2 if strict else 0).alias(kind), F.lit(name).alias("__ask"))
    sums = items.select(group, "pos", (F.col(before) + F.col(own)).cast("decimal(38,6)").alias("__v"), F.lit(1).alias(kind), F.lit(None).cast("string").alias("__ask"))
    points = sums
    for name, (target, strict) in targets.items():
        points = points.unionByName(ask(name, target, strict))
    order = ["__v", kind, "pos"]
    found = next_marked(ranged(points, [group], order), [group], order, F.when(F.col(kind) == 1, F.col("pos")), "__hit")
    asked = found.where(F.col("__ask").isNotNull())
    return asked.groupBy(group, "pos").agg(*(F.max(F.when(F.col("__ask") == n, F.col("__hit"))).alias(n) for n in targets))


def reached(jumps: DataFrame, group: str) -> DataFrame:
    """(group, pos) of all cuts that the first position of each group leads to over (group, pos, next), ``next`` being null behind the last."""
    marks = stored(jumps.groupBy(group).agg(F.min("pos").alias("pos")))
    jumps = stored(jumps.where("next IS NOT NULL"))
    while True:
        further = stored(marks.join(jumps, [group, "pos"]).select(group, F.col("next").alias("pos")))
        if further.isEmpty():
            return marks
        marks = stored(marks.unionByName(further))
        ahead = jumps.select(group, F.col("pos").alias("next"), F.col("next").alias("then"))
        jumps = stored(jumps.join(ahead, [group, "next"]).select(group, "pos", F.col("then").alias("next")))


def _numbered(items: DataFrame, group: str, order: str, jumps: DataFrame, out: str) -> DataFrame:
    """(group, order, out): how many cuts lie at or before each item, less one."""
    cuts = reached(jumps, group).withColumn("__cut", F.lit(1))
    flagged = items.join(cuts, [group, "pos"], "left").withColumn("__cut", F.coalesce("__cut", F.lit(0)))
    counted = running_sums(flagged, [group], [order], {"__cuts": F.col("__cut")})
    return counted.select(group, order, (F.col("__cuts") + F.col("__cut") - 1).cast("long").alias(out))


def _items(rows: DataFrame, group: str, order: str, sizes: dict[str, str]) -> DataFrame:
    """Ranged and stored (group, order, pos, sizes..., running sums before each item)."""
    own = {n: F.coalesce(F.col(c).cast(EXACT), F.lit(0).cast(EXACT)) for n, c in sizes.items()}
    placed = ranged(rows.select(group, order, *(c.alias(n) for n, c in own.items())), [group], [order])
    return stored(running_sums(placed, [group], [order], {"pos": F.lit(1).cast("long"), **{f"before_{n}": F.col(n) for n in sizes}}))


def pack_files(sizes: DataFrame, limit: float, files_per_chunk: int = 1000, group: str = "dataset", order: str = "episode_index", size: str = "size") -> DataFrame:
    """(group, order, chunk_index, file_index): files are filled in order until the next item would reach ``limit``; what is empty so far is never closed.

    A file from item i ends before the first item j of whom both hold: i to j reach the limit, and i to j - 1 aren't empty. A null size is 0; orders are distinct in a group.
    """
    items = _items(sizes, group, order, {"s": size})
    ends = first_reaching(items, group, "before_s", "s", {"full": (F.col("before_s") + _exact(limit), False), "any": (F.col("before_s"), True)})
    # Both must exist: a sum that nothing reaches leaves a null.
    cut = F.when(F.col("full").isNotNull() & F.col("any").isNotNull(), F.greatest("full", F.col("any") + 1))
    last = items.groupBy(group).agg(F.max("pos").alias("__last"))
    jumps = ends.join(last, group).select(group, "pos", F.when(cut <= F.col("__last"), cut).alias("next"))
    files = _numbered(items, group, order, jumps, "__file")
    return files.select(group, order, F.floor(F.col("__file") / files_per_chunk).cast("long").alias("chunk_index"), (F.col("__file") % files_per_chunk).alias("file_index"))


def batch_episodes(rows: DataFrame, group: str, order: str, size: str, frames: str, max_size: float, max_episodes: int, max_frames: int) -> DataFrame:
    """(group, order, batch): a batch is closed once its size or episodes reach their bound, or before its frames pass theirs."""
    items = _items(rows, group, order, {"s": size, "f": frames})
    heavy = first_reaching(items, group, "before_s", "s", {"heavy": (F.col("before_s") + _exact(max_size), False)})
    long = first_reaching(items, group, "before_f", "f", {"long": (F.col("before_f") + _exact(max_frames), True)})
    last = items.groupBy(group).agg(F.max("pos").alias("__last"))
    cut = F.greatest(F.least(F.col("heavy") + 1, F.col("long"), F.col("pos") + max_episodes), F.col("pos") + 1)
    jumps = heavy.join(long, [group, "pos"]).join(last, group).select(group, "pos", F.when(cut <= F.col("__last"), cut).alias("next"))
    return _numbered(items, group, order, jumps, "batch")
