"""Datasets that grow by commits: append, resume, read as of a version.

Layout under a root:

    meta/info.json                          fps, features and bounds, written once by ``create``
    batches/<folder>/data/chunk_index=../file_index=../   frames, one file for each number
    batches/<folder>/episodes, tasks, stats               metadata of the batch's episodes, the tasks that it added, stats of each episode
    log/00000000000000000001.json           one record for each commit; a reader sees the batches that records name, and nothing else

A batch is staged as a whole in a folder of its own, with the numbers that follow on the last record, and then committed by renaming one record to the next
number. A rename never replaces: if another writer has taken the number, the batch is staged anew behind it. What a lost writer has staged is
never seen (``sweep`` deletes it), and a batch that is appended again under its id is found in the log and not written twice.

Frames are cut into files by size (``operators.packing``); a batch begins a new file, as a closed Parquet file can't grow. Nothing passes through the driver but log
records and totals of one row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import cached_property, reduce
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajframe.operators.numbering import kept_episodes
from trajframe.operators.packing import pack_files
from trajframe.operators.scan import ranged, running_sums
from trajframe.operators.stats import merge_stats, per_episode_stats
from trajframe.sources.dataset import DEFAULTS, Dataset, Info, feature_type, read_text, schema_of, write_placed

#: Bytes of a value by its dtype, for the size of a frame before any file has been measured.
_WIDTHS = {"float64": 8, "int64": 8, "float32": 4, "int32": 4, "int16": 2, "int8": 1, "bool": 1}
_OTHER_WIDTH = 64


class Taken(Exception):
    """Another writer has committed under the number."""


@dataclass(frozen=True)
class Commit:
    """A record of the log: what the batch holds, and where the next one goes on."""

    version: int
    batch: str
    folder: str
    episodes: int
    frames: int
    files: int
    bytes: int
    next_episode: int
    next_index: int
    next_file: int
    next_task: int


class Appendable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, fps: int, features: dict, file_bytes: int = 100 << 20, files_per_chunk: int = 1000, robot_type: str | None = None) -> Appendable:
        """An empty dataset; a root that holds one is refused."""
        self = cls(spark, root)
        info = Info(fps, {**{n: {"dtype": d, "shape": [1]} for n, d in DEFAULTS.items()}, **features}, robot_type=robot_type, chunks_size=files_per_chunk)
        if file_bytes <= 0 or files_per_chunk <= 0:
            raise ValueError("sizes of files and chunks must be positive")
        try:
            self._put(f"{self.root}/meta/info.json", json.dumps(asdict(info) | {"file_bytes": file_bytes}))
        except Taken:
            raise ValueError(f"there is a dataset at {root}") from None
        return self

    # Files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @cached_property
    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        """Writes a small file beside its place and renames it: all of it or nothing appears, and what is there stays."""
        jvm, target = self.spark._jvm, self._path(path)
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), plainly)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(path) from None
            raise

    def _listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # Reading

    @cached_property
    def _info(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/meta/info.json"))

    @property
    def features(self) -> dict:
        return self._info["features"]

    def last(self) -> Commit | None:
        names = self._listed("log")
        return Commit(**json.loads(read_text(self.spark, f"{self.root}/log/{names[-1]}"))) if names else None

    def log(self, version: int | None = None) -> list[Commit]:
        """The records up to a version, the oldest first."""
        if not (names := self._listed("log")):
            return []
        found = [Commit(**json.loads(r[0])) for r in self.spark.read.text([f"{self.root}/log/{n}" for n in names]).collect()]
        return sorted((c for c in found if version is None or c.version <= version), key=lambda c: c.version)

    def _union(self, commits: list[Commit], part: str, schema: T.StructType | None = None) -> DataFrame:
        paths = [f"{self.root}/batches/{c.folder}/{part}" for c in commits]
        reader = self.spark.read.option("recursiveFileLookup", "true")
        return (reader.schema(schema) if schema else reader).parquet(*paths)

    def read(self, version: int | None = None) -> Dataset:
        """The dataset as of a version, by default the last; its stats are those of all its episodes merged."""
        commits = self.log(version)
        if not commits:
            raise ValueError("nothing is committed")
        last = commits[-1]
        known = {k: v for k, v in self._info.items() if k in Info.__dataclass_fields__}
        info = Info(**known | {"total_episodes": last.next_episode, "total_frames": last.next_index, "total_tasks": last.next_task, "splits": {"train": f"0:{last.next_episode}"}})
        stats = merge_stats(self._union(commits, "stats")) if self._measured else None
        return Dataset(self._union(commits, "data", schema_of(self.features)), self._union(commits, "episodes"), self._union(commits, "tasks"), info, stats)

    # Writing

    @property
    def _measured(self) -> list[str]:
        """Features with stats: numbers."""
        return [n for n, s in self.features.items() if n not in DEFAULTS and s["dtype"] in _WIDTHS and tuple(s.get("shape", (1,))) in ((1,), ())]

    def mismatches(self, rows: DataFrame, robot_type: str | None = None, fps: int | None = None) -> list[str]:
        """Everything by which rows, or the source that they come from, don't fit the dataset."""
        have = dict(rows.dtypes)
        want = {n: feature_type(s).simpleString() for n, s in self.features.items() if n not in DEFAULTS and s["dtype"] != "video"} | {"task": "string"}
        found = [f"{n} is missing" for n in want if n not in have] + [f"{n} is {have[n]}, not {k}" for n, k in want.items() if n in have and have[n] != k]
        found += [f"{what} is {given}, not {self._info[what]}" for what, given in (("robot_type", robot_type), ("fps", fps)) if given is not None and given != self._info[what]]
        return found

    def frame_bytes(self) -> float:
        """Bytes of a frame: as measured on what is committed, else by the features' widths."""
        if (last := self.last()) and last.next_index:
            return sum(c.bytes for c in self.log()) / last.next_index
        return float(sum(_WIDTHS.get(s["dtype"], _OTHER_WIDTH) * prod(s.get("shape") or [1]) for s in self.features.values() if s["dtype"] != "video"))

    def stage(self, rows: DataFrame, batch: str, order: list[str], episode: str = "episode_index", frame_bytes: float | None = None) -> Commit:
        """Writes a batch behind the last commit and returns the record that would commit it. Its episodes are numbered by ``episode``, an integer, their frames
        by ``order``; tasks that the dataset doesn't know get the next ids, by name."""
        if wrong := self.mismatches(rows):
            raise ValueError("; ".join(wrong))
        last = self.last() or Commit(0, "", "", 0, 0, 0, 0, 0, 0, 0, 0)
        folder = uuid.uuid4().hex
        base = f"{self.root}/batches/{folder}"
        per_frame, chunk = frame_bytes or self.frame_bytes(), self._info["chunks_size"]

        lengths = rows.groupBy(F.col(episode).alias("__key")).agg(F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_set("task")).alias("tasks"))
        lengths.write.parquet(f"{base}/lengths")
        lengths = self.spark.read.parquet(f"{base}/lengths")
        sizes = lengths.select(F.lit(0).alias("__one"), "__key", (F.col("length") * F.lit(per_frame)).alias("__bytes"))
        files = pack_files(sizes, self._info["file_bytes"], chunk, "__one", "__key", "__bytes")
        files = files.select("__key", (F.col("chunk_index") * chunk + F.col("file_index") + last.next_file).alias("__file"))
        placed = kept_episodes(lengths, "__key").join(files, "__key").join(lengths.select("__key", "tasks"), "__key")
        placed.select(
            (F.col("new_episode_index") + last.next_episode).alias("episode_index"),
            "length",
            (F.col("new_from_index") + last.next_index).alias("dataset_from_index"),
            (F.col("new_from_index") + last.next_index + F.col("length")).alias("dataset_to_index"),
            F.floor(F.col("__file") / chunk).alias("chunk_index"),
            (F.col("__file") % chunk).alias("file_index"),
            "tasks",
            F.col("__key").alias("source_episode"),
        ).write.parquet(f"{base}/episodes")
        known = self.spark.read.parquet(f"{base}/episodes")

        named = known.select(F.explode("tasks").alias("task")).distinct()
        earlier = self.log()
        if earlier:
            named = named.join(self._union(earlier, "tasks"), "task", "left_anti")
        numbered = running_sums(ranged(named, [], ["task"]), [], ["task"], {"__n": F.lit(1).cast("long")})
        numbered.select("task", (F.col("__n") + last.next_task).alias("task_index")).write.parquet(f"{base}/tasks")
        tasks = reduce(DataFrame.unionByName, [*([self._union(earlier, "tasks")] if earlier else []), self.spark.read.parquet(f"{base}/tasks")])

        own = [n for n in self.features if n not in DEFAULTS and self.features[n]["dtype"] != "video"]
        w = Window.partitionBy("__key").orderBy(*order)
        frames = rows.withColumn("__key", F.col(episode)).withColumn("__frame", (F.row_number().over(w) - 1).cast("long"))
        frames = frames.select("__key", "__frame", "task", *(F.col(f"`{n}`") for n in own))
        place = known.select(F.col("source_episode").alias("__key"), "episode_index", "dataset_from_index", "chunk_index", "file_index")
        frames = frames.join(place, "__key").join(tasks, "task").withColumn("timestamp", (F.col("__frame") / self._info["fps"]).cast("float"))
        frames = frames.withColumn("index", F.col("dataset_from_index") + F.col("__frame")).withColumnRenamed("__frame", "frame_index")
        columns = [F.col(f"`{c.name}`").cast(c.dataType) for c in schema_of(self.features)]
        # All of a file is in one task, which may write several.
        write_placed(frames.select(*columns, "chunk_index", "file_index"), f"{base}/data")
        staged = self.spark.read.schema(schema_of(self.features)).option("recursiveFileLookup", "true").parquet(f"{base}/data")
        if self._measured:
            per_episode_stats(staged, self._measured).write.parquet(f"{base}/stats")

        n = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("chunk_index", "file_index")).first()
        if staged.count() != n[1]:
            raise ValueError("frames were lost between the rows and the files")
        added = self.spark.read.parquet(f"{base}/tasks").count()
        size = self._fs.getContentSummary(self._path(f"{base}/data")).getLength()
        return Commit(last.version + 1, batch, folder, n[0], n[1], n[2], size, last.next_episode + n[0], last.next_index + n[1], last.next_file + n[2], last.next_task + added)

    def commit(self, staged: Commit) -> Commit:
        """Makes a staged batch part of the dataset by one rename; raises ``Taken`` if another one has its place."""
        self._put(f"{self.root}/log/{staged.version:020d}.json", json.dumps(asdict(staged)))
        return staged

    def append(self, rows: DataFrame, batch: str, order: list[str], episode: str = "episode_index", frame_bytes: float | None = None, attempts: int = 10) -> Commit:
        """Stages and commits a batch, once: a batch whose id the log has is left alone. Behind another writer it is staged anew."""
        for _ in range(attempts):
            if done := [c for c in self.log() if c.batch == batch]:
                return done[0]
            try:
                return self.commit(self.stage(rows, batch, order, episode, frame_bytes))
            except Taken:
                continue
        raise Taken(f"{attempts} other writers were faster")

    def sweep(self) -> list[str]:
        """Deletes staged folders that no record names, and returns them. Only while nobody writes."""
        named = {c.folder for c in self.log()}
        lost = [f for f in self._listed("batches") if f not in named]
        for f in lost:
            self._fs.delete(self._path(f"{self.root}/batches/{f}"), True)
        return lost
