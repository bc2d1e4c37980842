"""Shared folder for written intermediate tables, checkpoints and stream state.

Everything that must survive the loss of an executor goes through here: the folder is
the one the session names in ``spark.checkpoint.dir``. Only a local session without
that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_memo: dict[tuple, object] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="logloom-")
    context.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage and freezes values that must not change between two passes.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listing(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of a table's files, so that a changed table is not taken for the old one."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(place))


def once(spark: SparkSession, key: tuple, build: Callable[[], object], source: str | None = None) -> object:
    """Build a staged table once per Spark application, and anew when the files of ``source`` have changed."""
    full = (spark.sparkContext.applicationId, *key, *(_listing(spark, source) if source else ()))
    if full not in _memo:
        _memo[full] = build()
    return _memo[full]


def release(spark: SparkSession) -> None:
    """Delete everything this application wrote below the shared folder. Frames read from it end here."""
    from pyarrow import fs

    root = shared_root(spark)
    system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    folder = f"{base}/{spark.sparkContext.applicationId}"
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)
    _memo.clear()

