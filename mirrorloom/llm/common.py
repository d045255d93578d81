"""What several operators share: the shared work folder, and small Column builders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_TABLES: dict[int, tuple] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="mirrorloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))


def work_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, one per application.

    It lies in ``spark.checkpoint.dir``, which all executors share. Where that is
    unset, a temporary folder serves, but only on a local master.
    """
    ship(spark)
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="mirrorloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _ROOTS[app] = f"{base.rstrip('/')}/mirrorloom-{app}"
        atexit.register(_clear, spark, _ROOTS[app])
    return _ROOTS[app]


def _clear(spark: SparkSession, root: str) -> None:
    """Remove the written tables when the driver ends; of a session that was stopped before, those in a mounted folder."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        scheme, _, rest = root.rpartition(":")
        if scheme in ("", "file"):
            shutil.rmtree(rest, ignore_errors=True)
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the next join a
    plain scan, so that adaptive execution can split skewed partitions.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (weakref.ref(out), path)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once all that reads them is written."""
    for df in tables:
        known, path = _TABLES.pop(id(df), (lambda: None, ""))
        if known() is df:
            _clear(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null gives the empty text."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the identifier's text, modulo parts; a null identifier counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, close to those given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def new_column(df: DataFrame, name: str) -> None:
    """Raises where df has the column already, whatever its case, as the result would overwrite it."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already; name another one for the result")
