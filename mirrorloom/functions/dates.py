"""Date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rng import integer

# The formats that are tried, in this order.
FORMATS = ["MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "MM/dd/yy", "dd/MM/yy"]


def parse(c: Column, formats: list[str] = FORMATS) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def detect_format(df: DataFrame, col: str) -> DataFrame:
    """One row: the first format that fits all values (else the one that fits most), and the share that it fits."""
    c = F.col(col)
    one = df.filter(c.isNotNull()).agg(F.count("*").alias("n"), *[F.count(F.try_to_timestamp(c, F.lit(f))).alias(f"f{i}") for i, f in enumerate(FORMATS)])
    best = F.array_max(F.array(*[F.struct(F.col(f"f{i}").alias("hits"), F.lit(-i).alias("place")) for i in range(len(FORMATS))]))
    name = F.element_at(F.array(*map(F.lit, FORMATS)), 1 - best["place"])
    return one.select(name.alias("format"), (best["hits"] / F.col("n")).alias("share"))


def in_format(c: Column, format: str) -> Column:
    """Dates written in a format, as the one that ``detect_format`` finds; null stays."""
    return F.date_format(c, format)


def valid_range(c: Column, low: str = "1900-01-01", high: str = "2100-01-01") -> Column:
    """Dates outside the range become null."""
    return F.when(c.between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")), c)


def components(c: Column, prefix: str) -> list[Column]:
    parts = {"year": F.year, "month": F.month, "day": F.day, "weekday": F.weekday, "hour": F.hour}
    return [f(c).cast("int").alias(f"{prefix}_{k}") for k, f in parts.items()]


def month_year(c: Column) -> Column:
    """month/year; 01/2000 where there is no date."""
    return F.coalesce(F.concat(F.lpad(F.month(c).cast("string"), 2, "0"), F.lit("/"), F.year(c).cast("string")), F.lit("01/2000"))


def jitter(c: Column, days: int, seed: int, *key: Column) -> Column:
    """Moved by up to ``days`` days either way."""
    return F.date_add(c.cast("date"), integer(-days, days, seed, "jitter", *key).cast("int"))


def random_date(seed: int, *key: Column) -> Column:
    """A day from 2000-01-01 to 2023-12-31."""
    return F.date_add(F.lit("2000-01-01").cast("date"), integer(0, 8765, seed, "date", *key).cast("int"))
