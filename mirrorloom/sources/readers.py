"""Readers: files by suffix, folders, JDBC tables, spreadsheets."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import NULL_TOKENS, clean_frame
from ..rng import uniform

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def encoding_of(head: bytes) -> str:
    """The encoding of a file by its first bytes: a mark, else UTF-8 if it decodes, else Latin-1."""
    if head.startswith(b"\xff\xfe") or head.startswith(b"\xfe\xff"):
        return "UTF-16"
    try:
        head[: max(0, len(head) - 4)].decode("utf-8")
    except UnicodeDecodeError:
        return "ISO-8859-1"
    return "UTF-8"


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, clean: bool = True, **options) -> DataFrame:
    """A CSV file or folder with a header; malformed lines are dropped, null words become nulls.

    The encoding is told from the first file's head, which Spark's own reader fetches, so any store works.
    """
    if encoding is None:
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 10_000).alias("h")).limit(1).collect()
        encoding = encoding_of(bytes(head[0].h)) if head else "UTF-8"
    reader = spark.read.options(header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="DROPMALFORMED", encoding=encoding, **options)
    df = reader.csv(path)
    return clean_frame(df) if clean else df


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook by name: the first row as header, all values as text. A workbook is one small file."""
    out = {}
    with zipfile.ZipFile(path) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS)
        for i, sheet in enumerate(sheets, 1):
            rows = _sheet_rows(book.read(f"xl/worksheets/sheet{i}.xml"), shared)
            if len(rows) > 1:
                width = len(rows[0])
                header = [str(c or f"column_{k + 1}") for k, c in enumerate(rows[0])]
                body = [tuple((r + [None] * width)[:width]) for r in rows[1:]]
                out[sheet.attrib["name"]] = spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in header))
    return out


def _sheet_rows(xml: bytes, shared: list[str]) -> list[list]:
    rows = []
    for row in ElementTree.fromstring(xml).iter(f"{{{_NS['m']}}}row"):
        cells: list = []
        for c in row.findall("m:c", _NS):
            letters = re.match("[A-Z]+", c.attrib.get("r", "")) or re.match("A", "A")
            place = 0
            for ch in letters[0]:
                place = place * 26 + ord(ch) - 64
            cells += [None] * (place - 1 - len(cells))
            v, inline = c.find("m:v", _NS), c.find("m:is/m:t", _NS)
            text = inline.text if inline is not None else v.text if v is not None else None
            cells.append(shared[int(text)] if c.attrib.get("t") == "s" and text is not None else text)
        rows.append(cells)
    return rows


def read_file(spark: SparkSession, path: str) -> DataFrame | dict[str, DataFrame]:
    """csv, json, parquet or xlsx by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("json", "jsonl", "ndjson"):
        return spark.read.option("multiLine", suffix == "json").json(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "xlsx":
        return read_xlsx(spark, path)
    raise ValueError(f"no reader for {path}")


def read_folder(spark: SparkSession, folder: str, suffix: str = "csv", views: bool = True) -> dict[str, DataFrame]:
    """Each file of a folder as a table named after it, and as a temporary view. The listing goes through Hadoop, so any store works."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    out = {}
    for name in sorted(s.getPath().getName() for s in found):
        if name.lower().endswith(f".{suffix}"):
            table = re.sub(r"\W", "_", name[: -len(suffix) - 1])
            out[table] = read_file(spark, f"{folder.rstrip('/')}/{name}")
            if views:
                out[table].createOrReplaceTempView(table)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = 8, **properties) -> DataFrame:
    """A table of a database; with a numeric column and its range it is read in so many parts at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def load(spark: SparkSession, source: str, **options) -> dict[str, DataFrame]:
    """A folder of CSV files, a file, or the table of a database (jdbc:url, with table=)."""
    if source.startswith("jdbc:"):
        return {options["table"]: read_jdbc(spark, source, **options)}
    if re.search(r"\.(csv|json|jsonl|ndjson|parquet|xlsx)/?$", source, re.I):
        got = read_file(spark, source)
        return got if isinstance(got, dict) else {re.sub(r"\W", "_", source.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]): got}
    return read_folder(spark, source)


def preview(df: DataFrame, key: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash, all as text, nulls as empty text."""
    u = uniform(seed, "preview", *[F.col(k) for k in key])
    return df.withColumn("u_", u).orderBy("u_", *key).limit(n).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


__all__ = ["NULL_TOKENS", "encoding_of", "list_tables", "load", "preview", "read_csv", "read_file", "read_folder", "read_jdbc", "read_xlsx"]
