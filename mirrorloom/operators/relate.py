"""Relationships between columns and tables: correlations, association, order in time, keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..written import written
from .profile import exact_percentiles, number


def _pairs_row(df: DataFrame, pairs: list[tuple[str, str]], measure) -> DataFrame:
    """a, b, value: one aggregation for all pairs."""
    one = df.agg(*[measure(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("p")).select("p.*")


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r for unordered pairs; a row counts for a pair if both values are there."""
    return _pairs_row(df, list(combinations(cols, 2)), lambda a, b: F.corr(number(a), number(b)))


def correlation_report(df: DataFrame, cols: list[str], least: float = 0.7) -> DataFrame:
    """One row: pairs, strong pairs (over 0.8), moderate ones (over ``least``), the greatest and mean absolute correlation."""
    r = F.abs(F.col("r"))
    return pearson(df, cols).agg(
        F.count("r").alias("pairs"), F.count_if(r > 0.8).alias("strong"), F.count_if((r > least) & (r <= 0.8)).alias("moderate"),
        F.max(r).alias("max_abs"), F.avg(r).alias("mean_abs"))


def average_ranks(df: DataFrame, col: str, to: str) -> DataFrame:
    """df with the average rank of col's values. Ranks come from the counts of distinct values, so only those are sorted, in ranges."""
    x = number(col)
    counts = df.filter(x.isNotNull()).groupBy(x.alias("v_")).agg(F.count("*").alias("n_"))
    ranked = running(counts, "v_", ["n_"]).select("v_", (F.col("before_n_") + (F.col("n_") + 1) / 2).alias(to))
    return df.join(ranked, x == F.col("v_"), "left").drop("v_")


def running(counts: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """counts (a row for each value) with before_<c>, the sum of each column c over smaller values, and next_, the next value.

    The counts are dealt to ranges of values, as many as their size asks for, and written once with the number of
    the range; the sums of the ranges come first, so no task sees all values, and one pass inside the ranges follows.
    """
    ranged = written(counts.repartitionByRange(value).withColumn("range_", F.spark_partition_id()), "ranges")
    of_range = ranged.groupBy("range_").agg(F.min(value).alias("first_"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    by_range = Window.orderBy("range_")  # one row a range
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    starts = of_range.select("range_", F.lead("first_").over(by_range).alias("after_"), *[F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"start_{c}") for c in sums])
    inside = Window.partitionBy("range_").orderBy(value)
    own = ranged.withColumns({f"inside_{c}": F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums} | {"lead_": F.lead(value).over(inside)})
    joined = own.join(F.broadcast(starts), "range_")
    return joined.select(*counts.columns, *[(F.col(f"start_{c}") + F.col(f"inside_{c}")).alias(f"before_{c}") for c in sums], F.coalesce("lead_", "after_").alias("next_"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, r: Pearson's correlation of average ranks, over rows that have both values."""
    both = df.select(number(a).alias("x_"), number(b).alias("y_")).dropna()
    ranked = average_ranks(average_ranks(both, "x_", "rx_"), "y_", "ry_")
    return ranked.agg(F.corr("rx_", "ry_").alias("r")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: how often each pair of values occurs, without nulls."""
    return df.select(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))


def _association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row from the contingency table: n, rows and columns, chi2 (with Yates' correction for 2 x 2), mutual information."""
    cells = written(contingency(df, a, b), "cells")
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    size = rows.agg(F.sum("na").alias("t"), F.count("*").alias("k")).crossJoin(F.broadcast(cols.agg(F.count("*").alias("r"))))
    # Only cells that occur are met: the statistic over all cells is sum(n * n / e) - t. Of a table of 2 x 2 it is
    # corrected, where every cell lies as far from its expected number, and sum(1 / e) over all four is t ** 3 / (na * na' * nb * nb').
    full = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(size))
    expected = F.col("na") * F.col("nb") / F.col("t")
    p = F.col("n") / F.col("t")
    one = full.agg(
        F.max("t").alias("t"), F.max("k").alias("k"), F.max("r").alias("r"), (F.sum(F.col("n") * F.col("n") / expected) - F.max("t")).alias("plain"),
        F.max(F.abs(F.col("n") - expected)).alias("gap"), F.max("na").alias("na"), F.max("nb").alias("nb"),
        F.sum(p * F.log(p * F.col("t") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    gap = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    inverse = F.col("t") * F.col("t") * F.col("t") / (F.col("na") * (F.col("t") - F.col("na")) * F.col("nb") * (F.col("t") - F.col("nb")))
    return one.select("t", "k", "r", F.when((F.col("k") == 2) & (F.col("r") == 2), gap * gap * inverse).otherwise(F.greatest("plain", F.lit(0.0))).alias("chi2"), "mi")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, v: Cramér's V with bias correction."""
    n, k, r = F.col("t").cast("double"), F.col("k").cast("double"), F.col("r").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    least = F.least(k - (k - 1) * (k - 1) / (n - 1), r - (r - 1) * (r - 1) / (n - 1)) - 1
    return _association(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(least > 0, F.sqrt(phi / least)).otherwise(0.0).alias("v"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, mi: mutual information (nats) of two discrete columns, from the frequencies; bin numeric ones first."""
    return _association(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("mi"))


def information_matrix(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """a, b, n, mi: mutual information (nats) of every pair of columns, numbers by their quantile bins; n rows have both values.

    The bins' edges are exact, closed on the right, equal edges are one; values that aren't finite count as nulls. One scan deals each row's codes to the pairs, in each task
    first, and all margins come from grouping sets over the cells: with S the sum of n ln n over the cells or a margin, it is (S_ab - S_a - S_b) / t + ln t.
    A pair that no row has both values of, and an empty table, give n = 0 and null.
    """
    numbers = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, T.NumericType)]
    finite = {c: F.when(F.abs(number(c)) != float("inf"), number(c)) for c in numbers}
    edges = {r.column: sorted(set(r.q or [])) for r in exact_percentiles(df, finite, [i / bins for i in range(bins + 1)]).collect()} if numbers else {}  # bins + 1 values a column

    def code(c: str) -> Column:
        if c not in edges:
            return F.col(f"`{c}`").cast("string")
        inner = F.array(*[F.lit(float(e)) for e in edges[c][1:-1]]).cast("array<double>")
        return F.when(finite[c].isNotNull(), F.size(F.filter(inner, lambda e: e < finite[c]))).cast("string")

    pairs = list(combinations(range(len(cols)), 2))
    coded = df.select(*[code(c).alias(f"c{i}") for i, c in enumerate(cols)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"c{i}").alias("u"), F.col(f"c{j}").alias("v")) for p, (i, j) in enumerate(pairs)]))
    cells = coded.select(each.alias("e")).select("e.*").filter("u IS NOT NULL AND v IS NOT NULL").groupBy("p", "u", "v").agg(F.count("*").alias("n"))
    sets = cells.groupingSets([["p", "u", "v"], ["p", "u"], ["p", "v"], ["p"]], "p", "u", "v").agg(F.sum("n").alias("m"), F.grouping_id().alias("g"))
    spread = F.col("m") * F.log("m")
    sums = sets.groupBy("p").agg(F.max(F.when(F.col("g") == 3, F.col("m"))).alias("n"), F.sum(F.when(F.col("g") == 0, spread).when(F.col("g") < 3, -spread)).alias("s"))
    names = df.sparkSession.createDataFrame([(p, cols[i], cols[j]) for p, (i, j) in enumerate(pairs)], "p int, a string, b string")
    mi = F.greatest(F.lit(0.0), F.col("s") / F.col("n") + F.log("n"))
    return names.join(sums, "p", "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, mi).alias("mi"))


def quintiles(df: DataFrame, col: str, to: str, parts: int = 5) -> DataFrame:
    """df with the quantile bin of col (from 0): bins are closed on the right, the first on both sides, equal edges are one."""
    x = number(col)
    edges = exact_percentiles(df, {col: x}, [i / parts for i in range(parts + 1)]).select(F.array_distinct("q").alias("e_"))
    inner = F.slice("e_", 2, F.greatest(F.size("e_") - 2, F.lit(0)))
    return df.crossJoin(F.broadcast(edges)).withColumn(to, F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x)))).drop("e_")


def conditional_effect(df: DataFrame, a: str, b: str, given: str, least: int = 10) -> DataFrame:
    """One row: r, mean absolute r within bins of ``given``, and effect (1 - their ratio, in [0, 1])."""
    binned = quintiles(df.select(a, b, given).dropna(), given, "bin_")
    inside = binned.groupBy("bin_").agg(F.count("*").alias("n_"), F.corr(number(a), number(b)).alias("r_")).filter(F.col("n_") >= least)
    whole = df.select(a, b, given).dropna().agg(F.corr(number(a), number(b)).alias("r"))
    one = inside.agg(F.avg(F.abs(F.col("r_"))).alias("within")).crossJoin(F.broadcast(whole))
    effect = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("within") / F.abs(F.col("r"))))
    return one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(given).alias("given"), "r", "within", effect.alias("effect"))


def dependency_graph(df: DataFrame, numeric: list[str], categorical: list[str], threshold: float = 0.2) -> DataFrame:
    """src, dst, weight, kind: edges of Pearson's r or Cramér's V over the threshold, from the column of more entropy to the other."""
    from .profile import entropy

    strength = pearson(df, numeric).select("a", "b", F.abs(F.col("r")).alias("w"), F.lit("pearson").alias("kind"))
    for a, b in combinations(categorical, 2):
        strength = strength.unionByName(cramers_v(df, a, b).select("a", "b", F.col("v").alias("w"), F.lit("cramers_v").alias("kind")))
    h = entropy(df, numeric + categorical).select("column", "entropy")
    ha, hb = h.toDF("a", "ha"), h.toDF("b", "hb")
    e = strength.filter(F.col("w") > threshold).join(F.broadcast(ha), "a").join(F.broadcast(hb), "b")
    first = (F.col("ha") > F.col("hb")) | ((F.col("ha") == F.col("hb")) & (F.col("a") < F.col("b")))
    return e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dst"), F.col("w").alias("weight"), "kind")


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b with their fraction."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / 86_400_000_000.0


def temporal_order(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """One row: pairs, consistency (share of a <= b), from, to, and the durations in days clipped to 0 to 365: min, quartiles, max, mean."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(365.0), days_between(F.col(a), F.col(b))))
    ordered = (F.col(a) <= F.col(b)).cast("double")
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    one = both.agg(F.count("*").alias("pairs"), F.avg(ordered).alias("consistency"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"))
    one = one.crossJoin(F.broadcast(exact_percentiles(both, {"d": d}, [0.25, 0.5, 0.75]).select("q")))
    direction = lambda x, y: F.when(F.col("pairs") < least, None).when(F.col("consistency") > 0.75, x).when(F.col("consistency") < 0.25, y)
    return one.select(direction(F.lit(a), F.lit(b)).alias("from"), direction(F.lit(b), F.lit(a)).alias("to"), "pairs", "consistency", "min", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "median", "q75"))], "max", "mean")


def conditional_duration(df: DataFrame, a: str, b: str, category: str, least: int = 5, ratio: float = 1.2) -> DataFrame:
    """Per category: n, mean, median, min, max days from a to b (positive ones); dependent: whether the medians differ by the ratio."""
    from .profile import group_stats

    d = F.when(days_between(F.col(a), F.col(b)) > 0, days_between(F.col(a), F.col(b)))
    stats = group_stats(df, category, d, least)
    spread = stats.agg((F.max("median") > ratio * F.min("median")).alias("dependent"))
    return stats.crossJoin(F.broadcast(spread))


def foreign_keys(tables: dict[str, tuple[DataFrame, list[str]]], share: float = 0.8, least: int = 10) -> DataFrame:
    """child, child_column, parent, parent_column, shared, overlap: columns of two tables whose values overlap.

    The distinct values of all columns are stacked once and meet in one equi-join, which
    pre-aggregation makes as large as the values, not the rows. overlap: shared over the smaller number.
    """
    stacked = None
    for name, (df, cols) in tables.items():
        kinds = {c: "integer" if k in ("int", "bigint", "smallint", "tinyint") else k for c, k in df.dtypes}
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(kinds[c]).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols]))
        own = df.select(each.alias("e")).select(F.lit(name).alias("t"), "e.*").dropna().distinct()  # one scan a table
        stacked = own if stacked is None else stacked.unionByName(own)
    stacked = written(stacked, "values")
    sizes = stacked.groupBy("t", "c").agg(F.count("*").alias("n"))
    a, b = stacked.alias("a"), stacked.alias("b")
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.t") < F.col("b.t")))
    met = met.groupBy(F.col("a.t").alias("t1"), F.col("a.c").alias("c1"), F.col("b.t").alias("t2"), F.col("b.c").alias("c2")).agg(F.count("*").alias("shared"))
    out = met.join(F.broadcast(sizes.toDF("t1", "c1", "n1")), ["t1", "c1"]).join(F.broadcast(sizes.toDF("t2", "c2", "n2")), ["t2", "c2"])
    overlap = F.col("shared") / F.least("n1", "n2")
    return out.select("t1", "c1", "t2", "c2", "shared", overlap.alias("overlap")).filter((F.col("overlap") > share) & (F.col("shared") > least))
