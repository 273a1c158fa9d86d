"""Ordered scans whose work is dealt by ranges of the order, for sequences of any length.

``ranged`` deals rows by ranges of (group, order), so that one long group is spread over tasks. A scan then runs inside each range, and what a range hands
to the others (its sum, its first or last marked value) is one row: the windows over those have a row for each range of a group, never a row for each row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.streaming.storage import stored

RANGE = "__range"


def ranged(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range, which rises with (group, order). Stored: ranges are cut on samples, and must be the same to all that read them."""
    return stored(rows.repartitionByRange(*group, *order).withColumn(RANGE, F.spark_partition_id()))


def _with(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the other columns of the one row of ``parts`` that has their keys; a null key is one too."""
    named = parts.select(*(F.col(k).alias(f"__p_{k}") for k in keys), *(c for c in parts.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in keys))
    return rows.join(named, on).drop(*(f"__p_{k}" for k in keys))


def _handed(rows: DataFrame, group: list[str], carried: dict[str, Column], forward: bool) -> DataFrame:
    """(group, range, carried...): the carried values of the ranges before (or behind) each, which ``carried`` folds over a window of them."""
    w = Window.partitionBy(*group).orderBy(F.col(RANGE) if forward else F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*group, RANGE, *(c.over(w).alias(n) for n, c in carried.items()))


def running_sums(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Ranged rows with the sum of each value over the rows of the group before them."""
    values = rows.withColumns({f"__v_{n}": c for n, c in sums.items()})
    totals = values.groupBy(*group, RANGE).agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    bases = _handed(totals, group, {f"__b_{n}": F.sum(f"__t_{n}") for n in sums}, True)
    inside = Window.partitionBy(*group, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = values.withColumns({f"__i_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    out = _with(out, bases, [*group, RANGE])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*rows.columns, *((zero(f"__b_{n}") + zero(f"__i_{n}")).alias(n) for n in sums))


def next_marked(rows: DataFrame, group: list[str], order: list[str], value: Column, out: str, forward: bool = False) -> DataFrame:
    """Ranged rows with the value of the next row of the group that has one (that isn't null); with ``forward`` of the last row before."""
    marked = rows.withColumn("__m", value)
    place = F.struct(*order)
    end = F.max_by if forward else F.min_by
    ends = marked.where(F.col("__m").isNotNull()).groupBy(*group, RANGE).agg(end("__m", place).alias("__e"))
    # A range without a marked row hands on what it was handed, so every range has a row here.
    none = F.lit(None).cast(dict(ends.dtypes)["__e"])
    every = marked.select(*group, RANGE).distinct().withColumn("__e", none).unionByName(ends).groupBy(*group, RANGE).agg(F.first("__e", ignorenulls=True).alias("__e"))
    handed = _handed(every, group, {"__h": F.last("__e", ignorenulls=True)}, forward)
    by = [F.col(c) if forward else F.desc(c) for c in order]
    inside = Window.partitionBy(*group, RANGE).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    found = _with(marked.withColumn("__n", F.last("__m", ignorenulls=True).over(inside)), handed, [*group, RANGE])
    return found.select(*rows.columns, F.coalesce("__n", "__h").alias(out))
