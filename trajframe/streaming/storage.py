"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: (application, folder) of all folders made.
_MADE: list[tuple[str, str]] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where the session names none, a single machine gets a local one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    _MADE.append((spark.sparkContext.applicationId, path))
    return path


def clean_up(spark: SparkSession) -> int:
    """Deletes the folders that this session has made, once nothing that reads them is needed any more; how many there were."""
    own = [m for m in _MADE if m[0] == spark.sparkContext.applicationId]
    for made in own:
        where = spark._jvm.org.apache.hadoop.fs.Path(made[1])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(made)
    return len(own)


def kept(spark: SparkSession, path: str) -> bool:
    """Whether a folder that this session has made, or one inside it, is still there."""
    return any(path.startswith(folder) for app, folder in _MADE if app == spark.sparkContext.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a short lineage that survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
