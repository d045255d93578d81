"""Cleaning: missing values, outliers, types, duplicates, text and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import exact_percentiles, fences_row, number, numeric_columns, value_counts

# Texts that mean a missing value.
NULL_TOKENS = ["", "NULL", "null", "None", "none", "N/A", "n/a", "#N/A", "NaN", "nan"]


def clean_frame(df: DataFrame) -> DataFrame:
    """Headers trimmed and on one line, null words as nulls, rows and columns without values dropped; any number of columns."""
    names = [c.strip().replace("\n", " ").replace("\r", " ") for c in df.columns]
    df = df.toDF(*names).select(*[F.col(f"`{c}`") for c in names])
    texts = {f.name: F.when(~F.trim(F.col(f"`{f.name}`")).isin(NULL_TOKENS), F.trim(F.col(f"`{f.name}`"))) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    df = df.withColumns(texts).na.drop(how="all")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, mode: the most frequent value, of equal counts the smallest."""
    return value_counts(df, cols).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def impute(df: DataFrame, numeric: list[str], categorical: list[str], how: str = "mean") -> DataFrame:
    """Nulls of numeric columns as mean or median, of categorical ones as mode ('Unknown' if all are null)."""
    if how not in ("mean", "median"):
        raise ValueError(f"how is mean or median, not {how}")
    if how == "median" and numeric:
        middle = exact_percentiles(df, {c: number(c) for c in numeric}, [0.5])
        fills = middle.agg(*[F.max(F.when(F.col("column") == c, F.get("q", F.lit(0)))).alias(f"{c}:fill") for c in numeric])
    else:
        fills = df.agg(*[F.avg(number(c)).alias(f"{c}:fill") for c in numeric] or [F.count("*").alias(":n")])
    if categorical:
        best = modes(df, categorical).agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"{c}:fill") for c in categorical])
        fills = fills.crossJoin(F.broadcast(best))
    j = df.crossJoin(F.broadcast(fills))
    out = {c: F.coalesce(number(c), F.col(f"`{c}:fill`")) for c in numeric} | {c: F.coalesce(F.col(f"`{c}`"), F.col(f"`{c}:fill`"), F.lit("Unknown")) for c in categorical}
    return j.withColumns(out).drop(*fills.columns)


def winsorize(df: DataFrame, cols: list[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """Values beyond the fences as the fence."""
    fences = fences_row(df, cols, factor, exact)
    j = df.crossJoin(F.broadcast(fences))
    return j.withColumns({c: F.greatest(F.least(number(c), F.col(f"`{c}_high`")), F.col(f"`{c}_low`")) for c in cols}).drop(*fences.columns)


def forward_fill(df: DataFrame, col: str, order: list[str], by: list[str]) -> DataFrame:
    """Nulls as the last value before in the order, within each group; ``by`` keeps the windows of a bounded size."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def drop_unparsable(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows dropped in which a text of these columns is no number; nulls stay."""
    for c in cols:
        df = df.filter(F.col(c).isNull() | F.col(c).cast("string").try_cast("double").isNotNull())
    return df


def narrow_types(df: DataFrame) -> DataFrame:
    """Whole-number columns in the smallest type that holds them; one aggregation for all."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    if not cols:
        return df
    row = df.agg(*[f(c).alias(f"{k}:{c}") for c in cols for k, f in (("a", F.min), ("b", F.max))]).first()
    kinds = [("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63)]
    to = {c: next(k for k, m in kinds if -m <= (row[f"a:{c}"] or 0) and (row[f"b:{c}"] or 0) < m) for c in cols}
    return df.withColumns({c: F.col(c).cast(k) for c, k in to.items()})


def one_hot(df: DataFrame, col: str) -> DataFrame:
    """df with a 0/1 column for each value of col (in their order); an unknown value gives only zeros."""
    values = [r[0] for r in df.select(col).dropna().distinct().orderBy(col).limit(1001).collect()]
    if len(values) > 1000:
        raise ValueError(f"{col} has over 1000 values")
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def preprocess(df: DataFrame, null_share: float = 0.5) -> DataFrame:
    """Duplicates dropped, numbers by median and texts by mode where at most ``null_share`` is missing, outliers clipped, texts trimmed."""
    df = df.dropDuplicates()
    n = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c:{c}") for c in df.columns]).first()
    usable = [c for c in df.columns if n["n"] and 0 < n["n"] - n[f"c:{c}"] <= null_share * n["n"]]
    numeric = [c for c in numeric_columns(df)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = impute(df, [c for c in usable if c in numeric], [c for c in usable if c in texts], "median") if usable else df
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = winsorize(df, floats) if floats else df
    return df.withColumns({c: F.trim(F.col(f"`{c}`")) for c in texts}) if texts else df


def coerce_categories(df: DataFrame, col: str, known: list[str]) -> DataFrame:
    """Values outside the known ones become the first of them; nulls stay."""
    return df.withColumn(col, F.when(F.col(col).isNull() | F.col(col).isin(known), F.col(col)).otherwise(F.lit(known[0])))


def decode_one_hot(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """The inverse of one_hot: the value with the greatest of its columns, null where all are zero."""
    best = F.array_max(F.array(*[F.struct(F.col(f"{col}_{v}").alias("x"), F.lit(-i).alias("i")) for i, v in enumerate(values)]))
    label = F.get(F.array(*[F.lit(v) for v in values]), -best["i"])
    return df.withColumn(col, F.when(best["x"] > 0, label)).drop(*[f"{col}_{v}" for v in values])
