"""Column helpers and storage helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract counts words: a run of anything but ASCII white space.
WORD = r"[^ \t\n\x0B\f\r]+"
SPAN_TYPE = "array<struct<start:int,end:int,match:string>>"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


#: Items of an array that are folded into one result array at a time; appending costs the square of this, not of the array's size.
RUN = 256


def runs_of(items: Column) -> Column:
    """0, 1, ... for the runs of RUN items of an array."""
    none = F.array().cast("array<int>")
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))).otherwise(none)


def run_of(items: Column, number: Column) -> Column:
    return F.slice(items, number * RUN + 1, F.lit(RUN))


def then(step: Column, **fields) -> Column:
    """An array of one struct with further fields, each found once from the struct before; ``step`` is such an array."""
    return F.transform(step, lambda d: F.struct(d.alias("d"), *(f(d).alias(n) for n, f in fields.items())))


def find_spans(text: Column, pattern: str | Column, context: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point offsets, end exclusive; with a ``context`` also ``before``, so many characters in front.

    The pieces between matches (split) and the matches themselves (extract_all) alternate, so
    their running lengths are the offsets: a sum for each run of matches, then inside each run. Both see the whole text: look-behind works.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, rx, F.lit(0))
    gaps = F.split(text, rx, -1)
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(matches)),
        matches,
        lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"), *([F.right(g, F.lit(context)).alias("t")] if context else [])),
    )
    kind = SPAN_TYPE[:-2] + (",before:string>>" if context else ">>")

    def starts(d: Column) -> Column:
        sums = F.transform(runs_of(d["p"]), lambda r: F.aggregate(run_of(d["p"], r), F.lit(0), lambda acc, x: acc + x["g"] + x["n"]))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def within(d: Column, start: Column, run: Column) -> Column:
        last = lambda *parts: F.right(F.concat(*parts), F.lit(context))
        # Each match has a character, so the items before a run that matter are few.
        back = F.least(run * RUN, F.lit(context))
        lead = F.array_join(F.transform(F.slice(d["p"], run * RUN + 1 - back, back), lambda x: F.concat(x["t"], x["m"])), "") if context else None

        def step(acc: Column, x: Column) -> Column:
            before = [last(acc["tail"], x["t"]).alias("before")] if context else []
            span = F.struct((acc["pos"] + x["g"]).alias("start"), (acc["pos"] + x["g"] + x["n"]).alias("end"), x["m"].alias("match"), *before)
            tail = [last(acc["tail"], x["t"], x["m"]).alias("tail")] if context else []
            return F.struct((acc["pos"] + x["g"] + x["n"]).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"), *tail)

        first = F.struct(start.alias("pos"), F.array().cast(kind).alias("out"), *([last(lead).alias("tail")] if context else []))
        return F.aggregate(run_of(d["p"], run), first, step, lambda acc: acc["out"])

    placed = then(F.array(F.struct(pairs.alias("p"))), starts=starts)
    found = F.flatten(F.flatten(F.transform(placed, lambda e: F.transform(e["starts"], lambda at, run: within(e["d"], at, run)))))
    return F.when(F.regexp_like(text, rx), found).otherwise(F.array().cast(kind))


#: (application, folder) of all folders made.
_MADE: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees.

    Where the session names none, a single machine (tests) gets a local one; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/trajframe-{uuid.uuid4().hex}"
    _MADE.append((spark.sparkContext.applicationId, path))
    return path


def clean_up(spark: SparkSession) -> int:
    """Deletes what ``stored`` has written in this session, once no result that reads it is needed any more; how many folders there were."""
    own = [m for m in _MADE if m[0] == spark.sparkContext.applicationId]
    for made in own:
        where = spark._jvm.org.apache.hadoop.fs.Path(made[1])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(made)
    return len(own)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a short lineage that survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    # Spark deletes the shuffle files of a finished job once the driver's collector finds it unused; long operators would fill the disks before.
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
