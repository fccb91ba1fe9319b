"""Written intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a local folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name of its own in the shared folder."""
    return f"{shared_dir(spark)}/tracemill-{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tracemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(written: DataFrame) -> None:
    """Deletes the files of a table that ``settled`` wrote, once nothing reads it any more."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict[tuple, tuple[tuple, DataFrame]] = {}


def once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """The table ``build`` makes from ``source``, written the first time an application asks for it.

    It is written again when the source's size or time or ``version`` (what else it is made from) has changed, and when its
    files are gone; what it was before is deleted.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = (fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime(), version)
    key = (spark.sparkContext.applicationId, name, source)
    held = _KEPT.get(key)
    if held is not None and held[0] == state and exists(held[1]):
        return held[1]
    _KEPT[key] = (state, settled(build()))
    if held is not None and exists(held[1]):
        dropped(held[1])
    return _KEPT[key][1]


def exists(written: DataFrame) -> bool:
    """Whether the files of a written table are all there."""
    spark = written.sparkSession
    path = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f)
    return all(path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f)) for f in written.inputFiles()[:1])
