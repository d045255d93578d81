"""Writers by format. Distributed formats are written by Spark; single-file ones stream rows through the driver and are bounded."""

from __future__ import annotations

import csv
import io
import json
import sqlite3
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Single files are for small results: more rows are an error, never cut off.
MAX_SINGLE_FILE_ROWS = 1_048_575


def _rows(df: DataFrame):
    n = df.limit(MAX_SINGLE_FILE_ROWS + 1).count()
    if n > MAX_SINGLE_FILE_ROWS:
        raise ValueError("too many rows for a single file; write csv, json or parquet")
    return df.toLocalIterator(prefetchPartitions=True)


def _plain(v):
    return v if v is None or isinstance(v, (int, float, str)) and not isinstance(v, bool) else int(v) if isinstance(v, bool) else str(v)


def write_sqlite(tables: dict[str, DataFrame], path: str) -> None:
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" ({", ".join(f"""\"{c}\"""" for c in df.columns)})')
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(map(_plain, r)) for r in _rows(df)))


def write_zip(tables: dict[str, DataFrame], path: str) -> None:
    """A ZIP file with a CSV member for each table."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, df in tables.items():
            with archive.open(f"{name}.csv", "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                out = csv.writer(text)
                out.writerow(df.columns)
                out.writerows(_rows(df))


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each table."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = list(tables)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        sheets = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, name in enumerate(names, 1):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as raw:
                raw.write(f"{head}<worksheet {main}><sheetData>".encode())
                for row in (tables[name].columns, *_rows(tables[name])):
                    cells = "".join(f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>' for v in row)
                    raw.write(f"<row>{cells}</row>".encode())
                raw.write(b"</sheetData></worksheet>")


def write(tables: dict[str, DataFrame], path: str, format: str = "parquet", mode: str = "errorifexists", manifest: dict | None = None) -> None:
    """parquet, csv, json, orc: a folder for each table, written by all executors. sqlite, xlsx, zip: one file for all."""
    single = {"sqlite": write_sqlite, "xlsx": write_xlsx, "zip": write_zip}
    if format in single:
        return single[format](tables, path)
    if format not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"no writer for {format}")
    for name, df in tables.items():
        writer = df.write.mode(mode).format(format)
        (writer.option("header", True) if format == "csv" else writer).save(f"{path}/{name}.{format}")
    if manifest is not None:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def write_jdbc(tables: dict[str, DataFrame], url: str, mode: str = "append", **properties) -> None:
    for name, df in tables.items():
        df.write.jdbc(url, name, mode=mode, properties=properties)
