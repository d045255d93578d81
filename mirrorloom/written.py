"""Intermediate tables in the shared folder: they cut the lineage, survive lost executors and are read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_PATHS: dict[int, tuple] = {}


def folder(spark: SparkSession) -> str:
    """One folder for each application, in ``spark.checkpoint.dir``; on a local master without it a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="mirrorloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _FOLDERS[app] = f"{base.rstrip('/')}/mirrorloom-tables-{app}"
        atexit.register(remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if the session still runs; after it, if the folder is mounted."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        scheme, _, rest = path.rpartition(":")
        if scheme in ("", "file"):
            shutil.rmtree(rest, ignore_errors=True)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table that was written once."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave, once all that reads them is written itself."""
    for df in tables:
        known, path = _PATHS.pop(id(df), (lambda: None, ""))
        if known() is df:
            remove(df.sparkSession, path)
