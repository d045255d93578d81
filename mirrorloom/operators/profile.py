"""Column profiles in long form: a row for each column (and value), one pass over the data where it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..written import written

QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


def number(c: str) -> Column:
    """A column as double; NaN counts as missing."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def sketched(c: Column, shares: tuple[float, ...]) -> Column:
    """Percentiles from a sketch of fixed size: values of the column, at ranks that are off by a ten-thousandth at most."""
    return F.percentile_approx(c, list(shares), 10_000)


def exact_percentiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> DataFrame:
    """column, q: the percentiles (linear between values) of each named expression; null where it has no values.

    The values of all columns are counted, dealt to ranges and written once. Sums of the ranges come first,
    then only the ranges' rows that hold a rank asked for go on, so no task or buffer holds a whole column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), v.cast("double").alias("x")) for k, v in values.items()]))
    counts = df.select(pairs.alias("p")).select("p.*").filter("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange("column", "x").withColumn("range_", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("column", "range_").agg(F.sum("n").alias("s_"))
    by = Window.partitionBy("column").orderBy("range_")  # one row a range
    starts = sums.select("column", "range_", F.coalesce(F.sum("s_").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"), F.sum("s_").over(Window.partitionBy("column")).alias("t_"), "s_")
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("t_") - 1)).alias("pos")) for i, p in enumerate(shares)])
    wanted = starts.select("column", "range_", "start_", "s_", F.explode(ranks).alias("r")).select("*", "r.i", "r.pos", F.explode(F.array_distinct(F.array(F.floor("r.pos"), F.ceil("r.pos")))).alias("rank"))
    wanted = wanted.filter((F.col("rank") >= F.col("start_")) & (F.col("rank") < F.col("start_") + F.col("s_"))).select("column", "range_", "start_", "i", "pos", "rank")
    held = ranged.join(F.broadcast(wanted.select("column", "range_", "start_").distinct()), ["column", "range_"])
    inside = Window.partitionBy("column", "range_").orderBy("x")
    placed = held.withColumn("before_", F.col("start_") + F.sum("n").over(inside) - F.col("n")).select("column", "range_", "x", "n", "before_")
    met = placed.join(F.broadcast(wanted.select("column", "range_", "i", "pos", "rank")), ["column", "range_"]).filter((F.col("rank") >= F.col("before_")) & (F.col("rank") < F.col("before_") + F.col("n")))
    low, high = F.min("x"), F.max("x")
    each = met.groupBy("column", "i").agg((low + (high - low) * (F.max("pos") - F.floor(F.max("pos")))).alias("v"))
    lists = each.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("q"))
    names = df.sparkSession.createDataFrame([(k,) for k in values], "column string")
    return names.join(F.broadcast(lists), "column", "left")


def grouped_percentiles(df: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by, n, mean, min, max, q of each group: the rows with a value, and their percentiles (linear between values).

    Nulls are a group of their own, repeated rows count each, groups without a value and an empty table have no row.
    The values are counted first, then dealt to ranges of (group, value) and written once, so a group of any size is spread over many tasks.
    Only the values whose ranks are asked for go on. Nothing is broadcast by hint, as there may be as many groups as rows.
    """
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in by]).alias("key_"), value.cast("double").alias("x_")).filter("x_ is not null")
    counts = keyed.groupBy("key_", "x_").agg(F.count("*").alias("n_"))
    ranged = written(counts.repartitionByRange("key_", "x_").withColumn("range_", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("key_", "range_").agg(F.sum("n_").alias("s_"), F.sum(F.col("n_") * F.col("x_")).alias("w_"), F.min("x_").alias("low_"), F.max("x_").alias("high_"))
    sums = written(sums, "sums")  # a row for each group, and one more for each range that a group goes on into
    whole = sums.groupBy("key_").agg(F.sum("s_").alias("n"), (F.sum("w_") / F.sum("s_")).alias("mean"), F.min("low_").alias("min"), F.max("high_").alias("max"))
    of_key = Window.partitionBy("key_")
    starts = sums.select("key_", "range_", "s_", F.coalesce(F.sum("s_").over(of_key.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"), F.sum("s_").over(of_key).alias("t_"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("t_") - 1)).alias("pos")) for i, p in enumerate(shares)])
    held = F.filter(ranks, lambda r: (F.ceil(r.pos) >= F.col("start_")) & (F.floor(r.pos) < F.col("start_") + F.col("s_")))
    wanted = starts.select("key_", "range_", "start_", held.alias("ranks_")).filter(F.size("ranks_") > 0)
    # The values of a range are one task's, however many groups they are of.
    placed = ranged.withColumn("inside_", F.sum("n_").over(Window.partitionBy("range_", "key_").orderBy("x_")) - F.col("n_"))
    met = placed.join(wanted, ["key_", "range_"]).withColumn("from_", F.col("start_") + F.col("inside_"))
    hit = F.filter("ranks_", lambda r: (F.ceil(r.pos) >= F.col("from_")) & (F.floor(r.pos) < F.col("from_") + F.col("n_")))
    each = met.select("key_", "x_", F.explode(hit).alias("r")).groupBy("key_", "r.i", "r.pos").agg(F.min("x_").alias("a"), F.max("x_").alias("b"))
    at = each.select("key_", F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("v")).alias("e"))
    lists = at.groupBy("key_").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["v"]).alias("q"))  # one entry a share
    return whole.join(lists, "key_").select(*[F.col("key_")[c].alias(c) for c in by], "n", "mean", "min", "max", "q")


def quantile_rows(df: DataFrame, cols: list[str], shares: tuple[float, ...], exact: bool) -> DataFrame:
    """column, q: percentiles of the columns, exact or from sketches in one pass."""
    if exact:
        return exact_percentiles(df, {c: number(c) for c in cols}, list(shares))
    return _wide(df, cols, lambda c: {"q": sketched(number(c), shares)})


def unpivot(df: DataFrame, cols: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """One row for each row and column: name and value (as text). A narrow step: no shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("string").alias(value)) for c in cols]))
    return df.select(pairs.alias("p")).select(f"p.{name}", f"p.{value}")


def _wide(df: DataFrame, cols: list[str], measures) -> DataFrame:
    """One aggregation for all columns; measures(c) gives the named measures of a column. Then a row for each column."""
    aggs = [m.alias(f"{i}:{k}") for i, c in enumerate(cols) for k, m in measures(c).items()]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{i}:{k}`").alias(k) for k in measures(c)]) for i, c in enumerate(cols)]))
    return one.select(rows.alias("r")).select("r.*")


def adjusted_skew(g1: Column, n: Column) -> Column:
    """The sample skewness (G1) from the population's."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """The sample excess kurtosis (G2) from the population's."""
    return F.when(n > 3, ((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))


def numeric_profile(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column, count, nulls, min, max, mean, median, std, variance, skewness, kurtosis, quantiles, zeros, negatives, infinities."""
    cols = cols or numeric_columns(df)

    def measures(c: str) -> dict[str, Column]:
        x = number(c)
        return {
            "count": F.count(x),
            "nulls": F.count_if(x.isNull()),
            "min": F.min(x),
            "max": F.max(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "variance": F.var_samp(x),
            "g1": F.skewness(x),
            "g2": F.kurtosis(x),
            "zeros": F.count_if(x == 0),
            "negatives": F.count_if(x < 0),
            "infinities": F.count_if(F.abs(x) == float("inf")),
        }

    n = F.col("count").cast("double")
    wide = _wide(df, cols, measures).join(F.broadcast(quantile_rows(df, cols, QUANTILES, exact)), "column")
    return wide.select(
        "column", "count", "nulls", "min", "max", "mean", "std", "variance",
        adjusted_skew(F.col("g1"), n).alias("skewness"),
        adjusted_kurtosis(F.col("g2"), n).alias("kurtosis"),
        *[F.get("q", F.lit(i)).alias(f"q{round(q * 100):02d}") for i, q in enumerate(QUANTILES)],
        "zeros", "negatives", "infinities",
    )


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, value, n, total: frequencies without nulls. One shuffle for all columns, of values and not of rows."""
    counts = unpivot(df, cols).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column")  # one row for each column


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, distinct, total, most and least frequent value with counts, entropy (bits)."""
    counts = value_counts(df, cols)
    p = F.col("n") / F.col("total")
    return counts.groupBy("column").agg(
        F.count("*").alias("distinct"),
        F.first("total").alias("total"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("most_frequent"),
        F.max("n").alias("most_frequent_n"),
        F.min_by("value", F.struct("n", "value")).alias("least_frequent"),
        F.min("n").alias("least_frequent_n"),
        (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"),
    )


def top_values(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """column, rank, value, n: the most frequent values; equal counts in the order of the values."""
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = value_counts(df, cols).withColumn("rank", F.row_number().over(best))  # Spark keeps n rows a column before the shuffle
    return ranked.filter(F.col("rank") <= n).select("column", "rank", "value", "n")


def datetime_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, count, first, last, range_days, modal year and month (equal counts: the smaller), and days of the week (Monday first)."""

    def measures(c: str) -> dict[str, Column]:
        x = F.col(f"`{c}`").cast("timestamp_ntz")
        return {"count": F.count(x), "first": F.min(x), "last": F.max(x)} | {f"weekday_{d}": F.count_if(F.weekday(x) == d) for d in range(7)}

    wide = _wide(df, cols, measures)
    stamps = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("timestamp_ntz").alias("t")) for c in cols]))
    parts = df.select(stamps.alias("s")).filter("s.t is not null").select("s.column", F.year("s.t").alias("y"), F.month("s.t").alias("m"))
    counts = parts.groupBy("column", "y", "m").agg(F.count("*").alias("n"))
    mode = lambda part: counts.groupBy("column", part).agg(F.sum("n").alias("n")).groupBy("column").agg(F.min_by(part, F.struct(-F.col("n"), part)).alias({"y": "modal_year", "m": "modal_month"}[part]))
    seconds = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    out = wide.withColumn("range_days", F.floor(seconds / 86400).cast("long"))
    return out.join(F.broadcast(mode("y")), "column", "left").join(F.broadcast(mode("m")), "column", "left")


# The patterns of contacts, dates and numbers.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^[\d\-\(\)\+\s]{10,}"
URL = r"^https?://"
DATE = r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}"
NUMBER = r"^\s*[-+]?[$]?\d[\d,]*(\.\d+)?%?\s*$"


def shape(c: Column) -> Column:
    """The shape of a value: ASCII letters as L, digits as D."""
    return F.regexp_replace(F.regexp_replace(c, "[A-Za-z]", "L"), "[0-9]", "D")


def pattern_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """column and the number of values like e-mail, phone, URL, date, number, over all values."""

    def measures(c: str) -> dict[str, Column]:
        x = F.col(f"`{c}`").cast("string")
        like = {"email": EMAIL, "phone": PHONE, "url": URL, "date": DATE, "numeric": NUMBER}
        return {"total": F.count(x)} | {f"{k}_like": F.count_if(x.rlike(v)) for k, v in like.items()}

    return _wide(df, cols, measures)


def shapes(df: DataFrame, cols: list[str], n: int = 5) -> DataFrame:
    """column, rank, value (a shape), n: the most frequent shapes."""
    return top_values(df.select(*[shape(F.col(f"`{c}`").cast("string")).alias(c) for c in cols]), cols, n)


# The patterns of text columns, of phone numbers, and the parts of words that mark addresses.
TAGS = {
    "numeric_string": r"^\d+$",
    "code_pattern": r"^[A-Z]{2,3}\d+$",
    "date_string": r"^\d{4}-\d{2}-\d{2}$",
    "decimal_string": r"^\d+\.\d+$",
    "alpha_only": r"^[A-Za-z\s]+$",
    "title_case": r"^[A-Z][a-z\s]+$",
}
PHONES = [r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$", r"^\+?[0-9\s\-\(\)]{10,15}$"]
STREET_PARTS = ["street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln"]
ADDRESS_NAMES = ["address", "addr", "location"]


def contact_measures(c: str) -> dict[str, Column]:
    """The shares of a text column's values that are like an e-mail, like one of the two kinds of phone numbers, or hold a part of an address."""
    x = F.col(f"`{c}`").cast("string")
    share = lambda hit: F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))
    phones = F.greatest(*[share(x.rlike(p)) for p in PHONES])
    return {"email_ratio": share(x.rlike(EMAIL)), "phone_ratio": phones, "address_ratio": share(F.lower(x).rlike("|".join(STREET_PARTS)))}


def text_tags(df: DataFrame, cols: list[str], share: float = 0.7) -> DataFrame:
    """column, tag, ratio: the patterns that over ``share`` of a column's values follow."""
    wide = _wide(df, cols, lambda c: {k: F.avg(F.col(f"`{c}`").cast("string").rlike(v).cast("double")) for k, v in TAGS.items()})
    long = wide.select("column", F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), F.col(k).alias("ratio")) for k in TAGS])).alias("t"))
    return long.select("column", "t.tag", "t.ratio").filter(F.col("ratio") > share)


def contact_ratios(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, email_ratio, phone_ratio, address_ratio over all values, and the kind they suggest."""
    wide = _wide(df, cols, contact_measures)
    kind = F.when(F.col("email_ratio") > 0.8, "email").when(F.col("phone_ratio") > 0.7, "phone").when((F.col("address_ratio") > 0.3) | F.col("column").rlike("(?i)" + "|".join(ADDRESS_NAMES)), "address").otherwise("other")
    return wide.withColumn("kind", kind)


def column_basics(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, rows, nulls, null_ratio, distinct, distinct_ratio. Distinct values are counted exactly, over pre-aggregated values."""
    cols = cols or df.columns
    total = df.agg(F.count("*").alias("rows"))
    counts = unpivot(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))
    by = counts.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct"))
    return by.join(F.broadcast(total)).select("column", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_ratio"), "distinct", (F.col("distinct") / F.col("rows")).alias("distinct_ratio"))


def outlier_fences(df: DataFrame, cols: list[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """column, q1, q3, low, high."""
    wide = quantile_rows(df, cols, (0.25, 0.75), exact)
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return wide.select("column", q1.alias("q1"), q3.alias("q3"), (q1 - factor * (q3 - q1)).alias("low"), (q3 + factor * (q3 - q1)).alias("high"))


def fences_row(df: DataFrame, cols: list[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """One row with <column>_low and <column>_high, to be joined by broadcast."""
    one = quantile_rows(df, cols, (0.25, 0.75), exact).agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in cols])
    out = []
    for c in cols:
        q1, q3 = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        out += [(q1 - factor * (q3 - q1)).alias(f"{c}_low"), (q3 + factor * (q3 - q1)).alias(f"{c}_high")]
    return one.select(*out)


def outlier_counts(df: DataFrame, cols: list[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """column, outliers: values beyond the fences."""
    joined = df.crossJoin(F.broadcast(fences_row(df, cols, factor, exact)))  # one row
    return _wide(joined, cols, lambda c: {"outliers": F.count_if((number(c) < F.col(f"{c}_low")) | (number(c) > F.col(f"{c}_high")))})


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, and their percentages."""
    cells = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))
    groups = df.withColumn("missing_", cells).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n_"), F.sum("missing_").alias("m_"))
    one = groups.agg(F.sum("n_").alias("rows"), F.sum("m_").alias("missing"), F.count("*").alias("distinct_rows"))
    width = len(df.columns)
    return one.select(
        F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(width).cast("long").alias("columns"), F.coalesce("missing", F.lit(0)).alias("missing"),
        (100.0 * F.col("missing") / (F.col("rows") * width)).alias("missing_pct"),
        (F.coalesce("rows", F.lit(0)) - F.col("distinct_rows")).alias("duplicates"),
        (100.0 * (F.col("rows") - F.col("distinct_rows")) / F.col("rows")).alias("duplicate_pct"),
    )


def validation_summary(df: DataFrame, most_rows: int = 1_000_000, most_columns: int = 1000) -> DataFrame:
    """dataset_stats with valid and the warnings it gives."""
    s = dataset_stats(df)
    warn = F.array_compact(F.array(
        F.when(F.col("rows") > most_rows, "large dataset"), F.when(F.col("columns") > most_columns, "many columns"),
        F.when(F.col("missing_pct") > 50, "much missing"), F.when(F.col("duplicate_pct") > 20, "many duplicates")))
    return s.select("rows", "columns", "missing", "duplicates", (F.col("rows") > 0).alias("valid"), F.array_join(warn, ";").alias("warnings"))


def suspicious_columns(df: DataFrame) -> DataFrame:
    """column, constant, mostly_null, bad_characters."""
    basics = column_basics(df)
    bad = unpivot(df, df.columns).groupBy("column").agg(F.max(F.coalesce(F.col("value").contains("�"), F.lit(False))).alias("bad_characters"))
    out = basics.join(bad, "column").select("column", (F.col("distinct") == 1).alias("constant"), (F.col("null_ratio") > 0.95).alias("mostly_null"), "bad_characters")
    return out.filter("constant or mostly_null or bad_characters")


def data_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, completeness and uniqueness in percent, nulls, outliers (numeric columns)."""
    numeric = [c for c in cols if c in numeric_columns(df)]
    basics = column_basics(df, cols)
    out = basics.join(F.broadcast(outlier_counts(df, numeric)), "column", "left") if numeric else basics.withColumn("outliers", F.lit(None).cast("long"))
    return out.select("column", (100.0 * (1 - F.col("null_ratio"))).alias("completeness"), (100.0 * F.col("distinct_ratio")).alias("uniqueness"), "nulls", "outliers")


def distribution_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, n, mean, std, skewness, kurtosis, and D'Agostino and Pearson's test: statistic, p_value, is_normal."""
    p = numeric_profile(df, cols)
    n = F.col("count").cast("double")
    x = df.agg(*[f(number(c)).alias(f"{c}:{k}") for c in cols for k, f in (("g1", F.skewness), ("g2", F.kurtosis))])
    g = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}:g1`").alias("g1"), F.col(f"`{c}:g2`").alias("g2")) for c in cols])).alias("s")).select("s.*")
    j = p.join(F.broadcast(g), "column")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    s = (F.col("g2") + 3 - mean) / F.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    root = (1 - 2 / a) / (1 + s * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(root) * F.pow(F.abs(root), 1 / 3)) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return j.select("column", "count", "mean", "std", "skewness", "kurtosis", k2.alias("statistic"), F.exp(-k2 / 2).alias("p_value"), (F.exp(-k2 / 2) > 0.05).alias("is_normal"))


def entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, distinct, entropy (nats) and concentration (the share of the most frequent value)."""
    p = F.col("n") / F.col("total")
    return value_counts(df, cols).groupBy("column").agg(F.count("*").alias("distinct"), (-F.sum(p * F.log(p))).alias("entropy"), F.max(p).alias("concentration"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """bin (from 0), low, high, n: equal widths from the minimum to the maximum, the last bin closed."""
    x = number(col)
    edge = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    joined = df.filter(x.isNotNull()).crossJoin(F.broadcast(edge))
    return joined.groupBy(place.alias("bin"), F.col("lo"), F.col("hi")).agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def group_stats(df: DataFrame, by: str, value: Column, least: int = 5) -> DataFrame:
    """Per category: n, mean, median, min, max of a value, for categories of at least ``least`` rows."""
    stats = grouped_percentiles(df, [by], value, [0.5]).filter(F.col("n") >= least)
    return stats.select(by, "n", "mean", F.get("q", F.lit(0)).alias("median"), "min", "max")


def text_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, shortest, longest, mean_length, special (any), mixed_case (any)."""

    def measures(c: str) -> dict[str, Column]:
        x = F.col(f"`{c}`").cast("string")
        mixed = (F.lower(x) != x) & (F.upper(x) != x)
        return {"shortest": F.min(F.length(x)), "longest": F.max(F.length(x)), "mean_length": F.avg(F.length(x)), "special": F.max(x.rlike("[^A-Za-z0-9 ]")), "mixed_case": F.max(mixed)}

    return _wide(df, cols, measures)
