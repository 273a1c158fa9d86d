"""Datasets on a Hadoop file system: frames, episodes and dictionaries as Parquet, info and stats as JSON.

Layout under a root: data/chunk-XXX/file-XXX (written by Spark, clustered by episode so that row groups prune),
meta/episodes, meta/tasks, meta/subtasks, meta/info.json, meta/stats.json.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from trajframe.operators.numbering import cumulative_offsets

VERSION = "v3.0"
DEFAULTS = {"timestamp": "float32", "frame_index": "int64", "episode_index": "int64", "index": "int64", "task_index": "int64"}
_KINDS = {
    "float32": T.FloatType(), "float64": T.DoubleType(), "int64": T.LongType(), "int32": T.IntegerType(),
    "int16": T.ShortType(), "int8": T.ByteType(), "bool": T.BooleanType(), "string": T.StringType(),
}


@dataclass
class Info:
    fps: int
    features: dict
    codebase_version: str = VERSION
    robot_type: str | None = None
    total_episodes: int = 0
    total_frames: int = 0
    total_tasks: int = 0
    chunks_size: int = 1000
    splits: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.fps <= 0:
            raise ValueError("fps must be positive")
        for name in self.features:
            if "/" in name:
                raise ValueError(f"a feature's name may not hold '/': {name}")

    @classmethod
    def parse(cls, text: str) -> Info:
        known = json.loads(text)
        major = int(known.get("codebase_version", VERSION).lstrip("v").split(".")[0])
        if major < int(VERSION[1]):
            raise ValueError(f"datasets of version {known['codebase_version']} must be converted first")
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})


def feature_type(spec: dict) -> T.DataType:
    """The Spark type of a feature {"dtype", "shape"}."""
    if spec["dtype"] == "image":
        return T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
    if spec["dtype"] not in _KINDS:
        raise ValueError(f"unknown dtype {spec['dtype']!r}")
    kind: T.DataType = _KINDS[spec["dtype"]]
    shape = tuple(spec.get("shape", (1,)))
    for _ in () if shape in ((1,), ()) else shape:
        kind = T.ArrayType(kind, containsNull=False)
    return kind


def schema_of(features: dict) -> T.StructType:
    """Columns of the frames table; videos are pointers on episodes, not columns."""
    return T.StructType([T.StructField(n, feature_type(s)) for n, s in features.items() if s["dtype"] != "video"])


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _arrow_uri(spark: SparkSession, folder: str) -> str | None:
    """The folder's full address, where Arrow can write to its file system too."""
    from pyarrow import fs

    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ImportError):
        return None
    return uri


def write_files(rows: DataFrame, folder: str, place: Column, order: list[str], drop: tuple[str, ...] = ()) -> None:
    """Many small files: each row goes to the file (.parquet, or .csv with a header and doubled quotes) that ``place`` names under the folder, sorted by ``order``, without the columns ``drop``.

    Spark's writer asks the file system several times for each file and renames all of them in the driver at the end; here a task writes its files, in pieces of an Arrow batch,
    and gives each its name once it is whole, so a task that is repeated replaces what it has written. Raises ``OSError`` if Arrow can't write there."""
    uri = _arrow_uri(rows.sparkSession, folder)
    if uri is None:
        raise OSError(f"Arrow can't write to {folder}")
    where = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(where)  # there is a folder even without rows
    dealt = rows.withColumn("__place", place).repartition("__place").sortWithinPartitions("__place", *order).drop(*drop)

    def work(batches):
        from pyarrow import csv, fs, parquet

        to, base = fs.FileSystem.from_uri(uri)
        made, now, writer, out, draft, n = set(), None, None, None, "", 0

        def done():
            writer.close()
            out.close()
            to.move(draft, f"{base}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n])], ["place", "n"])

        for batch in batches:
            at = batch.schema.get_field_index("__place")
            names, own, lo = batch.column(at), pa.Table.from_batches([batch]).drop_columns(["__place"]), 0
            for name, hi in _runs(names):
                if name != now:
                    if now is not None:
                        yield done()
                    now, n = name, 0
                    above, _, last = f"{base}/{name}".rpartition("/")
                    if above not in made:
                        to.create_dir(above, recursive=True)
                        made.add(above)
                    draft = f"{above}/.{last}.{uuid.uuid4().hex}"
                    out = to.open_output_stream(draft)
                    writer = csv.CSVWriter(out, own.schema) if name.endswith(".csv") else parquet.ParquetWriter(out, own.schema)
                writer.write_table(own.slice(lo, hi - lo))
                n, lo = n + hi - lo, hi
        if now is not None:
            yield done()

    dealt.mapInArrow(work, "place string, n long").agg(F.sum("n")).first()


#: Small files that a task reads, on average, and rows that it hands on at once.
FILES_A_TASK, ROWS_AT_ONCE = 256, 16_384


def read_files(places: DataFrame, folder: str, n_files: int) -> DataFrame:
    """The rows of many small Parquet files of one schema, whose places under the folder are the only column of ``places``.

    Spark's scan lists all files and opens each anew at some milliseconds; here tasks are dealt names and read the files in turn. Raises ``OSError`` if Arrow can't read there
    or the folder has other files than these: not ``n_files``, or none at the first place. A task fails where one is missing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, uri, one = places.sparkSession, _arrow_uri(places.sparkSession, folder), places.first()
    if uri is None or one is None:
        raise OSError(f"Arrow can't read from {folder}, or there is nothing")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(f"{folder}/{one[0]}")) or files.getContentSummary(path(folder)).getFileCount() != n_files:
        raise OSError(f"{folder} has other files")
    kind = spark.read.parquet(f"{folder}/{one[0]}").schema
    schema = to_arrow_schema(kind)

    def work(batches):
        from pyarrow import fs, parquet

        to, base = fs.FileSystem.from_uri(uri)
        held, rows = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with to.open_input_file(f"{base}/{name}") as file:
                    for part in parquet.ParquetFile(file).iter_batches(ROWS_AT_ONCE, columns=schema.names):
                        held.append(pa.Table.from_batches([part]).select(schema.names).cast(schema))
                        rows += part.num_rows
                        if rows >= ROWS_AT_ONCE:
                            yield from pa.concat_tables(held).combine_chunks().to_batches()
                            held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    n = max(spark.sparkContext.defaultParallelism, -(-n_files // FILES_A_TASK))
    return places.repartition(n).mapInArrow(work, kind)


def write_placed(frames: DataFrame, folder: str) -> None:
    """A file for each (chunk_index, file_index), sorted by index."""
    parts = ("chunk_index", "file_index")
    try:
        place = F.concat(F.lit("chunk_index="), F.col(parts[0]).cast("string"), F.lit("/file_index="), F.col(parts[1]).cast("string"), F.lit("/part-0.parquet"))
        write_files(frames, folder, place, ["index"], parts)
    except OSError:
        frames.repartition(*parts).sortWithinPartitions(*parts, "index").write.partitionBy(*parts).parquet(folder)


def _runs(names: pa.Array) -> list[tuple[str, int]]:
    """(value, end) of each run of equal values."""
    import pyarrow.compute as pc

    ends = pc.run_end_encode(names)
    return list(zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True))


@dataclass
class Dataset:
    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame
    info: Info
    stats: DataFrame | None = None
    subtasks: DataFrame | None = None

    def write(self, root: str) -> None:
        """Frames are range-partitioned by episode and sorted by index, so a filter on episodes skips files and row groups. Where the episodes have files
        (chunk_index, file_index), each file holds its episodes and nothing else."""
        spark = self.frames.sparkSession
        if "file_index" in self.episodes.columns:
            placed = self.frames.join(self.episodes.select("episode_index", "chunk_index", "file_index"), "episode_index").select(*self.frames.columns, "chunk_index", "file_index")
            write_placed(placed, f"{root}/data")
        else:
            self.frames.repartitionByRange("episode_index").sortWithinPartitions("index").write.parquet(f"{root}/data")
        self.episodes.write.parquet(f"{root}/meta/episodes")
        self.tasks.coalesce(1).write.parquet(f"{root}/meta/tasks")
        if self.subtasks is not None:
            self.subtasks.coalesce(1).write.parquet(f"{root}/meta/subtasks")
        if self.stats is not None:
            self.stats.coalesce(1).write.json(f"{root}/meta/stats.json")
        _write_text(spark, json.dumps(asdict(self.info)), f"{root}/meta/info.json")

    @classmethod
    def read(cls, spark: SparkSession, root: str, episodes: list[int] | None = None) -> Dataset:
        info = Info.parse(read_text(spark, f"{root}/meta/info.json"))
        frames = spark.read.schema(schema_of(info.features)).option("recursiveFileLookup", "true").parquet(f"{root}/data")
        known = spark.read.parquet(f"{root}/meta/episodes")
        known = known.select(*(F.col(f"`{c}`") for c in known.columns if not c.startswith("stats/")))
        if episodes is not None:
            frames, known = (d.where(F.col("episode_index").isin(episodes)) for d in (frames, known))
        return cls(frames, known, spark.read.parquet(f"{root}/meta/tasks"), info, _optional(spark, "json", f"{root}/meta/stats.json"), _optional(spark, "parquet", f"{root}/meta/subtasks"))


def modified(data: Dataset, add: dict[str, tuple[Column, dict]] | None = None, remove: list[str] | None = None) -> Dataset:
    """The dataset with features added, (column, {"dtype", "shape"}) each, and removed: frames, the features' list and the stats go together. Stats of removed features
    go; those of added numbers are found from the frames."""
    from trajframe.operators.edit import modify_features
    from trajframe.operators.stats import merge_stats, per_episode_stats

    add, remove = add or {}, remove or []
    frames = modify_features(data.frames, {n: c for n, (c, _) in add.items()}, remove)
    features = {n: s for n, s in data.info.features.items() if n not in remove} | {n: s for n, (_, s) in add.items()}
    stats = data.stats
    if stats is not None:
        stats = stats.where(~F.col("feature").isin(remove)) if remove else stats
        numbers = [n for n, (_, s) in add.items() if s["dtype"] in _KINDS and s["dtype"] not in ("string", "bool") and tuple(s.get("shape", (1,))) in ((1,), ())]
        if numbers:
            own = merge_stats(per_episode_stats(frames, numbers))
            own = own.withColumn("dim", F.lit(0)) if "dim" in stats.columns else own
            stats = stats.unionByName(own, allowMissingColumns=True)
    return replace(data, frames=frames, info=replace(data.info, features=features), stats=stats)


def _optional(spark: SparkSession, kind: str, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def build(rows: DataFrame, fps: int, order: list[str], features: dict, robot_type: str | None = None) -> Dataset:
    """A dataset from rows (episode_index, task, features...): frames are numbered, tasks get ids by name, episodes are summed up."""
    w = Window.partitionBy("episode_index").orderBy(*order)
    numbered = rows.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long")).withColumn("timestamp", (F.col("frame_index") / fps).cast("float"))
    tasks = rows.select("task").distinct().withColumn("task_index", (F.row_number().over(Window.orderBy("task")) - 1).cast("long"))
    per = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_set("task")).alias("tasks"))
    known = cumulative_offsets(per, "length", "episode_index", "dataset_from_index", "dataset_to_index")
    frames = numbered.join(tasks, "task").join(known.select("episode_index", "dataset_from_index"), "episode_index")
    frames = frames.withColumn("index", F.col("dataset_from_index") + F.col("frame_index"))
    features = {**{n: {"dtype": d, "shape": [1]} for n, d in DEFAULTS.items()}, **features}
    totals = known.agg(F.count(F.lit(1)), F.sum("length")).first()
    info = Info(fps, features, robot_type=robot_type, total_episodes=totals[0], total_frames=totals[1] or 0, total_tasks=tasks.count(), splits={"train": f"0:{totals[0]}"})
    return Dataset(frames.select(*(F.col(f"`{c.name}`").cast(c.dataType) for c in schema_of(features))), known, tasks, info)


def integrity(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_index, length_ok, bounds_ok, dense_ok) for every known episode; null where it has no frames."""
    seen = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"))
    e = episodes.join(seen, "episode_index", "left")
    return e.select(
        "episode_index",
        (F.col("n") == F.col("length")).alias("length_ok"),
        ((F.col("lo") == F.col("dataset_from_index")) & (F.col("hi") == F.col("dataset_to_index"))).alias("bounds_ok"),
        ((F.col("hi") - F.col("lo")) == F.col("n")).alias("dense_ok"),
    )


def file_report(path_or_df: DataFrame) -> DataFrame:
    """(file, bytes, rows) of a file-based table; sizes are those on disk."""
    rows = path_or_df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def frame_violations(frames: DataFrame, features: dict) -> DataFrame:
    """(column, problem, n): what a schema check finds, and vectors of the wrong length or with nulls."""
    found = []
    have, want = dict(frames.dtypes), {n: feature_type(s).simpleString() for n, s in features.items() if s["dtype"] != "video"}
    found += [(n, "missing column", 1) for n in want if n not in have] + [(n, "extra column", 1) for n in have if n not in want]
    found += [(n, f"type {have[n]} instead of {want[n]}", 1) for n in want if n in have and have[n] != want[n]]
    out = frames.sparkSession.createDataFrame(found, "column string, problem string, n long")
    vectors = [(n, s["shape"][0]) for n, s in features.items() if n in have and have[n] == want.get(n) and len(s.get("shape", ())) == 1 and s["shape"][0] > 1]
    for n, size in vectors:
        bad = frames.where(F.col(f"`{n}`").isNull() | (F.size(f"`{n}`") != size)).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        out = out.unionByName(bad.select(F.lit(n).alias("column"), F.lit("wrong length").alias("problem"), "n"))
    scalars = [n for n, s in features.items() if n in have and have[n] == want.get(n) and n not in dict(vectors)]
    if scalars:
        nulls = frames.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in scalars))
        each = F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.lit("null value").alias("problem"), F.col(f"`{n}`").alias("n")) for n in scalars)))
        out = out.unionByName(nulls.select(each).where("n > 0"))
    return out


def read_legacy_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes, episode stats and tasks of the older layout: one JSON object a line."""
    return tuple(spark.read.json(f"{root}/meta/{n}.jsonl") for n in ("episodes", "episodes_stats", "tasks"))


def convert_legacy(spark: SparkSession, root: str, fps: int, features: dict, file_bytes: float | None = None, frame_bytes: float = 0.0, files_per_chunk: int = 1000) -> Dataset:
    """The older layout (a file per episode, JSON lines) as a dataset: dictionaries joined, offsets and totals found anew, quantiles kept that all stats have.

    With ``file_bytes`` the episodes are packed into files of that size, a frame being taken as ``frame_bytes``."""
    from trajframe.operators.packing import pack_files
    from trajframe.operators.stats import merge_stats

    episodes, stats, tasks = read_legacy_lines(spark, root)
    known = cumulative_offsets(episodes.select("episode_index", "tasks", "length"), "length", "episode_index", "dataset_from_index", "dataset_to_index")
    totals = known.agg(F.count(F.lit(1)), F.sum("length")).first()
    info = Info(fps, features, total_episodes=totals[0], total_frames=totals[1] or 0, total_tasks=tasks.count(), splits={"train": f"0:{totals[0]}"})
    try:
        frames = read_files(episodes.select(episode_file("episode_index", "parquet").alias("place")), f"{root}/data", totals[0])
    except OSError:
        frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
        if "episode_index" not in frames.columns:  # as folders by episode
            frames = spark.read.parquet(f"{root}/data")
    if file_bytes is not None:
        sizes = known.select(F.lit(0).alias("__one"), "episode_index", (F.col("length") * frame_bytes).alias("__bytes"))
        known = known.join(pack_files(sizes, file_bytes, files_per_chunk, "__one", "episode_index", "__bytes").drop("__one"), "episode_index")
    names = stats.schema["stats"].dataType.names
    shared = set.intersection(*(set(stats.schema["stats"].dataType[n].dataType.names) for n in names))
    pick = lambda n: F.struct(*(F.col(f"stats.`{n}`.{c}").alias(c) for c in sorted(shared)))
    parts = stats.select("episode_index", F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), pick(n).alias("s")) for n in names))))
    own = [{q for q in stats.schema["stats"].dataType[n].dataType.names if q[0] == "q" and q[1:].isdigit()} for n in names]
    fields = ["min", "max", "mean", "std", *sorted(set.intersection(*own))]
    flat = parts.select("feature", F.posexplode(F.arrays_zip(*(f"s.{c}" for c in fields))).alias("dim", "z"), F.get("s.count", F.lit(0)).alias("count"))
    merged = merge_stats(flat.select("feature", "dim", "z.*", "count"), ("feature", "dim"))
    return Dataset(frames, known, tasks.select("task", "task_index"), info, merged)


def read_streams(spark: SparkSession, glob: str, episode_pattern: str = r"([^/]+)/[^/]+\.csv$") -> DataFrame:
    """CSV series of many episodes: the episode from the path, the time column under any of its names, numbers only."""
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(glob)
    time = next((c for c in rows.columns if c.lower() in ("timestamp", "time", "t")), None)
    if time is None:
        raise ValueError("no column timestamp, time or t")
    numbers = [c for c, k in rows.dtypes if c != time and k in ("int", "bigint", "double", "float")]
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), episode_pattern, 1).alias("episode"), F.col(time).cast("double").alias("timestamp"), *numbers)


def pair_streams(states: DataFrame, actions: DataFrame, key: str = "episode", time: str = "timestamp") -> DataFrame:
    """States and actions of an episode paired by row, as long as the shorter one; episodes without a pair drop out."""
    number = lambda d: d.withColumn("frame_index", (F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1).cast("long"))
    return number(states).join(number(actions).drop(time), [key, "frame_index"])


def flatten_episodes(nested: DataFrame, steps: str = "steps") -> DataFrame:
    """Frames from one row per episode with an array of step structs; the episode's other columns are copied to each."""
    others = [c for c in nested.columns if c != steps]
    return nested.select(*others, F.posexplode(steps).alias("frame_index", "__s")).select(*others, F.col("frame_index").cast("long").alias("frame_index"), "__s.*")


def flatten_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(file, success, reward) of evaluation reports: ``aggregated`` or else ``overall``; NaN is null, the first success given wins."""
    rows = spark.read.option("multiLine", "true").option("allowNonNumericNumbers", "true").json(path)
    blocks = [b for b in ("aggregated", "overall") if b in rows.columns]
    clean = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    pick = lambda names: F.coalesce(*(clean(F.col(f"{b}.{n}")) for b in blocks for n in names if n in rows.schema[b].dataType.names), F.lit(None).cast("double"))
    return rows.select(F.col("_metadata.file_name").alias("file"), pick(("pc_success", "success_rate", "success")).alias("success"), pick(("avg_sum_reward", "reward")).alias("reward"))


def transitions_to_episodes(rows: DataFrame, env: str, order: list[str], ends: Column | str) -> DataFrame:
    """Ordered transitions as frames: adds episode_index, frame_index and index. An episode ends where ``ends`` holds; what is left at an
    environment's end is an episode too. Environments, numbered by integers, come one after another."""
    w = Window.partitionBy(env).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__end", (F.expr(ends) if isinstance(ends, str) else ends).cast("int"))
    numbered = numbered.withColumn("__seg", F.coalesce(F.sum("__end").over(before), F.lit(0))).withColumn("__row", F.row_number().over(w) - 1)
    numbered = numbered.withColumn("frame_index", (F.row_number().over(Window.partitionBy(env, "__seg").orderBy(*order)) - 1).cast("long"))
    per = numbered.groupBy(env).agg((F.max("__seg") + 1).alias("__episodes"), F.count(F.lit(1)).alias("__rows"))
    per = cumulative_offsets(per, "__episodes", env, "__e", "__e1")
    per = cumulative_offsets(per, "__rows", env, "__i", "__i1").select(env, "__e", "__i")
    out = numbered.join(per, env).withColumn("episode_index", (F.col("__e") + F.col("__seg")).cast("long")).withColumn("index", (F.col("__i") + F.col("__row")).cast("long"))
    return out.drop("__end", "__seg", "__row", "__e", "__i")


def images_to_pointers(frames: DataFrame, episodes: DataFrame, images: list[str], fps: float, kept: Column | None = None, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """A dataset whose image columns have become video files, all but the encoding: frames and stats without them, episodes numbered
    anew with pointers videos/<image>/{from,to}_timestamp into one file for each image."""
    from trajframe.operators.numbering import kept_episodes, renumber

    chosen = kept_episodes(episodes if kept is None else episodes.where(kept))
    rows = renumber(frames.drop(*images), chosen)
    ends = {f"videos/{i}/{side}_timestamp": (F.col("new_from_index") + more) / fps for i in images for side, more in (("from", F.lit(0)), ("to", F.col("length")))}
    return rows, chosen.withColumns(ends), None if stats is None else stats.where(~F.col("feature").isin(images))


def episode_file(episode: str, kind: str) -> Column:
    """chunk-000/episode_000000.<kind>: a thousand episodes' files in a folder."""
    return F.format_string(f"chunk-%03d/episode_%06d.{kind}", F.floor(F.col(episode) / 1000), F.col(episode).cast("long"))


def write_legacy(frames: DataFrame, tasks: DataFrame, features: list[str], root: str) -> None:
    """The older layout: a file for each episode, JSON lines for episodes, their stats and tasks."""
    per = frames.groupBy("episode_index").agg(F.array_sort(F.collect_set("task")).alias("tasks"), F.count(F.lit(1)).alias("length"))
    from trajframe.operators.stats import QUANTILES, quantile_key

    moments = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop} | {quantile_key(q): (lambda c, q=q: F.percentile(c, F.lit(q))) for q in QUANTILES}
    values = lambda c: F.struct(*(F.array(f(c)).alias(n) for n, f in moments.items()), F.array(F.count(c)).alias("count"))
    stats = frames.groupBy("episode_index").agg(F.struct(*(values(c).alias(c) for c in features)).alias("stats"))
    name = episode_file("episode_index", "parquet")
    try:
        write_files(frames, f"{root}/data", name, ["frame_index"])
    except OSError:
        frames.repartition("episode_index").sortWithinPartitions("frame_index").write.partitionBy("episode_index").parquet(f"{root}/data")
    for name, rows in (("episodes", per), ("episodes_stats", stats), ("tasks", tasks)):
        rows.write.json(f"{root}/meta/{name}.jsonl")
