"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that changes over training time. Its schedule is integrated to a cumulative
token demand; the source's documents, in a fixed pseudo-random order and repeated as often as needed, fill that
demand, and inverting it gives each document the time (0 to 1) at which it is trained on. The mix is the documents
range-sorted by that time.

The last, partial pass over a source takes documents that are large for it (LARGE of it or more) only after all others, so
that it ends close to its target.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own and comes last;
rows repeated under one id are separate documents with the same place in the order. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import count_words, read, stored, whole_text

CYCLE = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: How the weight of the first, second and third source of a cycle changes: its value at time 0 and at time 1, as
#: a multiple of its mean. The linear path between them integrates to 1.
SLOPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Rows of one prefix-sum bucket, on average.
BUCKET_ROWS = 4096
#: A document is large for a partial pass if it is this share of it.
LARGE = 0.02


def source_targets(sizes: DataFrame, cycle=CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, rank, source_size, target) from (source, size).

    With the sources by rising cap-to-weight ratio, the first ones hit their cap and the rest share what is left
    by weight; a source is capped exactly if its cap is at most its share of what the earlier ones leave. The two
    windows without a partition run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(rest))
    per = per.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level of the first source that isn't capped holds for all from there on; behind it the levels fall.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    per = per.withColumn("final", final)
    target = F.when(F.col("capped") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, cycle=CYCLE, max_repeats: int = MAX_REPEATS, slopes=SLOPES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, first_position) for every document.

    ``docs`` needs doc_id, source, size. The running size within a source is found in two levels: a sum per bucket
    of the pseudo-random order, a running sum over those sums, and a running sum inside each bucket. Buckets hold
    some thousand rows, so that no task gets a whole source.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("?", F.lit(""), "size", "source"))
    docs = stored(docs.select("doc_id", "source", "size", F.md5(name).alias("h")))  # narrow, and read several times
    targets = source_targets(docs, cycle, max_repeats)
    rows = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS))
    known = targets.alias("t").join(rows.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source"))).select("t.*", "r.buckets")
    spread = docs.alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")), "left")
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    # Whole passes over the source, then the documents whose middle lies before the end of the last, partial one.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.col("target") - passes * F.col("source_size")
    large = (F.col("size") > part * LARGE).cast("int")
    bucket = F.floor(place * F.col("k.buckets")) + large * F.col("k.buckets")
    spread = spread.select("d.doc_id", "d.source", "d.size", "d.h", "k.rank", "k.source_size", "k.target", bucket.alias("bucket"))
    sums = spread.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(sums, ["rank", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    copies = F.when(F.col("size") > 0, passes + (F.col("at") + F.col("size") / 2 <= part).cast("int")).otherwise(F.lit(0))
    out = out.withColumn("copies", F.least(copies, F.lit(max_repeats)).cast("int"))
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies",
        "at",
        "rank",
    )


def position(taken_before: Column, target: Column, rank: Column, slopes=SLOPES) -> Column:
    """The training time at which a source's cumulative demand reaches ``taken_before`` words.

    A weight that runs from w0 to w1 times its mean has the demand target * (w0 t + (w1 - w0) t^2 / 2); this solves it for t.
    """
    pick = (rank % len(slopes) + 1).cast("int")
    w0 = F.element_at(F.array(*(F.lit(float(a)) for a, _ in slopes)), pick)
    w1 = F.element_at(F.array(*(F.lit(float(b)) for _, b in slopes)), pick)
    y = F.least(F.greatest(taken_before / F.nullif(target, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    bend = (w1 - w0) / 2
    root = F.sqrt(F.greatest(w0 * w0 + 4 * bend * y, F.lit(0.0)))
    return F.least(F.when(bend == 0, y / w0).otherwise(2 * y / (w0 + root)), F.lit(1.0))


def training_order(mixed: DataFrame, slopes=SLOPES) -> DataFrame:
    """One row for each copy that is trained on, with its position."""
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = (F.col("at") + F.col("copy") * F.col("source_size")).cast("double")
    placed = copies.withColumn("position", position(at, F.col("target"), F.col("rank"), slopes))
    return placed.select("doc_id", "copy", "position")


def mixed_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of the mix in training order, one row for each copy; ``docs`` has doc_id and source.

    Rows repeated under one id are sized once. A row without an id is a document of its own, placed by its content; equal
    rows without an id are each sized, and each copy of each of them is a row of the result.
    """
    content = F.concat(F.lit("?"), F.md5(F.to_json(F.struct(*docs.columns))))
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), content))
    named, unnamed = keyed.where("doc_id IS NOT NULL"), keyed.where("doc_id IS NULL")
    sizes = lambda rows: rows.select(F.col("__key").alias("doc_id"), "source", count_words(whole_text(text_col)).alias("size"))
    order = training_order(mix(sizes(named).dropDuplicates(["doc_id"]).unionByName(sizes(unnamed))))
    order = order.select(F.col("doc_id").alias("__key"), F.col("copy").alias("__copy"), F.col("position").alias("__at"))
    placed = named.unionByName(unnamed.dropDuplicates(["__key"])).join(order, "__key")
    return placed.repartitionByRange("__at", "__key", "__copy").sortWithinPartitions("__at", "__key", "__copy").select(*docs.columns)


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", count_words(whole_text(text_col)).alias("size"))


def op10_mixing(spark, sf_dir):
    mixed = mix(sized(read(spark, sf_dir, "documents")))
    first = position(F.col("at").cast("double"), F.col("target"), F.col("rank"))
    placed = mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(F.when(F.col("copies") > 0, first), 9).alias("position")
    )
    order = (F.col("position").asc_nulls_last(), "doc_id")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


#: The same targets by pouring from the lowest cap up, the same order by md5, in DuckDB.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT max(level) AS final FROM l WHERE cap > level * weight),
t AS (SELECT source, rank, source_size, CASE WHEN cap <= level * weight OR final IS NULL THEN cap ELSE final * weight END AS target FROM l, f),
o AS (
  SELECT d.doc_id, d.size, t.rank, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.size > (target - floor(target / source_size) * source_size) * 0.02::DOUBLE, d.h, d.doc_id) - d.size AS BIGINT) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size > 0 THEN floor(target / source_size) +
         CASE WHEN done + size / 2.0::DOUBLE <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies FROM o),
p AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS bend, least(done / target, 1) AS y FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN round(least(2 * y / (w0 + sqrt(greatest(w0 * w0 + 4 * bend * y, 0))), 1), 9) END AS position
FROM p
"""
