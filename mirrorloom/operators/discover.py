"""Searches over all columns of a table: order in time, durations by category, dependencies, keys, and a full profile."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..written import written
from .profile import column_basics, exact_percentiles, grouped_percentiles, number, numeric_columns, text_columns, value_counts
from .relate import conditional_effect, days_between, dependency_graph, mutual_information, pearson

# Parts of column names of which a pair of dates must hold one to be searched by name.
TEMPORAL_NAMES = ["admit", "discharge", "start", "end", "in", "out"]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def temporal_orders(df: DataFrame, cols: list[str] | None = None, named: bool = False, least: int = 10) -> DataFrame:
    """from, to, pairs, consistency, and the days between (clipped to 0 to 365): min, q25, median, q75, max, mean.

    A row for each pair of date columns of which one comes first in over three quarters of at least ``least`` rows. All
    pairs are counted in one pass; those found are measured in a second. named: only pairs with a name of TEMPORAL_NAMES.
    """
    cols = cols or date_columns(df)
    pairs = [(a, b) for a, b in combinations(cols, 2) if not named or any(n in a.lower() or n in b.lower() for n in TEMPORAL_NAMES)]
    schema = "from string, to string, pairs long, consistency double, min double, q25 double, median double, q75 double, max double, mean double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    both = lambda a, b: F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
    counted = df.agg(*[e for i, (a, b) in enumerate(pairs) for e in (F.count_if(both(a, b)).alias(f"n{i}"), F.avg((F.col(f"`{a}`") <= F.col(f"`{b}`")).cast("double")).alias(f"c{i}"))]).first()  # one row
    found = {}
    for i, (a, b) in enumerate(pairs):
        n, share = counted[f"n{i}"], counted[f"c{i}"]
        if n >= least and not 0.25 <= share <= 0.75:
            found[f"{i}"] = (a, b, n, share) if share > 0.75 else (b, a, n, share)
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    days = {k: F.when(both(a, b), F.greatest(F.lit(0.0), F.least(F.lit(365.0), days_between(F.col(f"`{a}`"), F.col(f"`{b}`"))))) for k, (a, b, _, _) in found.items()}
    sums = df.agg(*[f(d).alias(f"{k}:{n}") for k, d in days.items() for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(n).cast("long").alias("pairs"), F.lit(share).alias("consistency"), *[F.col(f"`{k}:{m}`").alias(m) for m in ("min", "max", "mean")]) for k, (a, b, n, share) in found.items()]))
    quartiles = exact_percentiles(df, days, [0.25, 0.5, 0.75])
    out = sums.select(rows.alias("r")).select("r.*").join(F.broadcast(quartiles), "column")
    return out.select("from", "to", "pairs", "consistency", "min", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "median", "q75"))], "max", "mean")


def duration_dependencies(df: DataFrame, start: str, end: str, cols: list[str], least: int = 5, ratio: float = 1.2, most: int = 20) -> DataFrame:
    """column, value, n, mean, median days of each category's rows with a positive duration, for the columns on which it depends.

    A column of 2 to ``most`` values is searched; it counts if the medians of its categories (of ``least`` rows) differ by ``ratio``.
    """
    days = days_between(F.col(f"`{start}`"), F.col(f"`{end}`"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
    long = df.select(days.alias("d_"), each.alias("e")).filter("d_ > 0").select("d_", "e.*").dropna()
    found = grouped_percentiles(long, ["column", "value"], F.col("d_"), [0.5])
    stats = written(found.select("column", "value", "n", "mean", F.get("q", F.lit(0)).alias("median")), "stats")
    by = stats.groupBy("column").agg(F.count("*").alias("values_"), F.max(F.when(F.col("n") >= least, F.col("median"))).alias("hi_"), F.min(F.when(F.col("n") >= least, F.col("median"))).alias("lo_"))
    good = by.filter(F.col("values_").between(2, most) & (F.col("hi_") > ratio * F.col("lo_"))).select("column")
    return stats.filter(F.col("n") >= least).join(F.broadcast(good), "column")


def relationships(df: DataFrame, numeric: list[str], categorical: list[str], dates: list[str], threshold: float = 0.2, least_information: float = 0.0) -> DataFrame:
    """kind, a, b, given, strength: everything found between a table's columns.

    dependency: edges of the dependency graph. information: mutual information of two categories over the least. temporal: the
    consistency of the order of two dates. conditional: how much a third number explains of a strong correlation.
    """
    none = F.lit(None).cast("string").alias("given")
    out = dependency_graph(df, numeric, categorical, threshold).select(F.lit("dependency").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), none, F.col("weight").alias("strength"))
    for a, b in combinations(categorical, 2):
        out = out.unionByName(mutual_information(df, a, b).filter(F.col("mi") > least_information).select(F.lit("information").alias("kind"), "a", "b", none, F.col("mi").alias("strength")))
    if len(dates) > 1:
        out = out.unionByName(temporal_orders(df, dates).select(F.lit("temporal").alias("kind"), F.col("from").alias("a"), F.col("to").alias("b"), none, F.greatest("consistency", 1 - F.col("consistency")).alias("strength")))
    strong = [(r.a, r.b) for r in pearson(df, numeric).filter(F.abs("r") > threshold).collect()] if len(numeric) > 2 else []  # a row for each pair of columns
    for a, b in strong:
        for given in [c for c in numeric if c not in (a, b)]:
            out = out.unionByName(conditional_effect(df, a, b, given).select(F.lit("conditional").alias("kind"), "a", "b", "given", F.col("effect").alias("strength")))
    return out


def key_candidates(df: DataFrame, share: float = 0.95) -> DataFrame:
    """column, distinct_ratio: columns whose distinct values are at least ``share`` of the rows."""
    return column_basics(df).filter(F.col("distinct_ratio") >= share).select("column", "distinct_ratio")


def correlated_pairs(df: DataFrame, cols: list[str], least: float = 0.7) -> DataFrame:
    """a, b, r, strength: the pairs over the least, strong ones over 0.8."""
    r = F.abs(F.col("r"))
    return pearson(df, cols).filter(r > least).select("a", "b", "r", F.when(r > 0.8, "strong").otherwise("moderate").alias("strength"))


def type_counts(df: DataFrame) -> DataFrame:
    """kind, columns: how many columns are numbers, texts, dates or something else."""
    kinds = ["number" if c in numeric_columns(df) else "text" if c in text_columns(df) else "date" if c in date_columns(df) else "other" for c in df.columns]
    return df.sparkSession.createDataFrame([(k, kinds.count(k)) for k in sorted(set(kinds))], "kind string, columns int")


def full_profile(df: DataFrame) -> DataFrame:
    """A row for each column: kind, rows, nulls, distinct, mode and its share of all rows, numbers' min, max, mean and deviation, texts' shortest and longest, dates' first and last."""
    numbers, texts, dates = numeric_columns(df), text_columns(df), date_columns(df)
    best = value_counts(df, df.columns).groupBy("column").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value")).alias("m"))
    null = lambda t: F.lit(None).cast(t)
    aggs = []
    for i, c in enumerate(df.columns):
        x, text, day = number(c) if c in numbers else null("double"), F.length(F.col(f"`{c}`")) if c in texts else null("int"), F.col(f"`{c}`").cast("timestamp_ntz") if c in dates else null("timestamp_ntz")
        aggs += [f(v).alias(f"{i}:{k}") for k, f, v in (("min", F.min, x), ("max", F.max, x), ("mean", F.avg, x), ("std", F.stddev_samp, x), ("shortest", F.min, text), ("longest", F.max, text), ("first", F.min, day), ("last", F.max, day))]
    names = ("min", "max", "mean", "std", "shortest", "longest", "first", "last")
    kind = {c: "number" if c in numbers else "text" if c in texts else "date" if c in dates else "other" for c in df.columns}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind[c]).alias("kind"), *[F.col(f"`{i}:{k}`").alias(k) for k in names]) for i, c in enumerate(df.columns)]))
    wide = df.agg(*aggs).select(rows.alias("r")).select("r.*")
    joined = wide.join(F.broadcast(column_basics(df)), "column").join(F.broadcast(best), "column", "left")
    return joined.select("column", "kind", "rows", "nulls", "distinct", F.col("m.value").alias("mode"), (F.col("m.n") / F.col("rows")).alias("mode_share"), *names)


def column_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, is_integer (every number is whole), is_binary (two values at most), has_time (a date with a time of day)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        whole = F.min((number(c) == F.floor(number(c))).cast("int")) == 1 if c in numeric_columns(df) else F.lit(False)
        timed = F.max((F.date_trunc("day", x.cast("timestamp_ntz")) != x.cast("timestamp_ntz")).cast("int")) == 1 if c in date_columns(df) else F.lit(False)
        aggs += [F.coalesce(whole, F.lit(False)).alias(f"{i}:w"), F.coalesce(timed, F.lit(False)).alias(f"{i}:t")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{i}:w`").alias("is_integer"), F.col(f"`{i}:t`").alias("has_time")) for i, c in enumerate(cols)]))
    wide = df.agg(*aggs).select(rows.alias("r")).select("r.*")
    return wide.join(F.broadcast(column_basics(df, cols)), "column").select("column", "is_integer", (F.col("distinct") <= 2).alias("is_binary"), "has_time")


def binned_entropy(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """column, entropy (nats) of a number's histogram of equal widths."""
    from .profile import histogram

    h = histogram(df, col, bins)
    t = h.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return h.crossJoin(F.broadcast(t)).agg((-F.sum(p * F.log(p))).alias("entropy")).select(F.lit(col).alias("column"), "entropy")
