"""Parametric fits: moments and a histogram come from Spark in one pass each; the fit is arithmetic on a few numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import quantile as normal_quantile
from ..rng import normal, uniform
from .generate import _slots, draw_category
from .profile import number

BINS = 20


def _densities(mean: float, var: float, log_mean: float | None, log_var: float | None) -> dict[str, tuple[dict, object]]:
    """Families on values scaled to [0, 1], by the method of moments: parameters and density."""
    std = math.sqrt(var)
    out: dict[str, tuple[dict, object]] = {
        "normal": ({"mean": mean, "std": std}, lambda x: np.exp(-0.5 * ((x - mean) / std) ** 2) / (std * math.sqrt(2 * math.pi))),
        "uniform": ({"low": 0.0, "high": 1.0}, lambda x: np.ones_like(x)),
    }
    if mean > 0:
        out["exponential"] = ({"rate": 1 / mean}, lambda x: np.exp(-x / mean) / mean)
        shape, scale = mean * mean / var, var / mean
        out["gamma"] = ({"shape": shape, "scale": scale}, lambda x: np.exp((shape - 1) * np.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale)))
        k = (std / mean) ** -1.086  # a close fit of the shape by the coefficient of variation
        lam = mean / math.gamma(1 + 1 / k)
        out["weibull"] = ({"shape": k, "scale": lam}, lambda x: k / lam * (x / lam) ** (k - 1) * np.exp(-((x / lam) ** k)))
    if 0 < mean < 1 and var < mean * (1 - mean):
        t = mean * (1 - mean) / var - 1
        a, b = mean * t, (1 - mean) * t
        out["beta"] = ({"a": a, "b": b}, lambda x: np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)))
    if log_var:
        s = math.sqrt(log_var)
        out["lognormal"] = ({"mean": log_mean, "std": s}, lambda x: np.exp(-0.5 * ((np.log(x) - log_mean) / s) ** 2) / (x * s * math.sqrt(2 * math.pi)))
    return out


def fit(df: DataFrame, col: str) -> DataFrame:
    """family, sse, best, parameters, low, high: the squared error of each family's density against the histogram."""
    x = number(col)
    edge = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    if edge.n < 10 or edge.lo == edge.hi:
        rows = []
    else:
        scaled = (x - edge.lo) / (edge.hi - edge.lo)
        place = F.least(F.floor(scaled * BINS), F.lit(BINS - 1)).cast("int")
        s = df.agg(F.avg(scaled).alias("m"), F.var_pop(scaled).alias("v"), F.avg(F.log(F.when(scaled > 0, scaled))).alias("lm"), F.var_pop(F.log(F.when(scaled > 0, scaled))).alias("lv")).first()
        counts = {r.b: r.n for r in df.filter(x.isNotNull()).groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}  # BINS rows
        height = np.array([counts.get(i, 0) for i in range(BINS)]) / edge.n * BINS
        middle = (np.arange(BINS) + 0.5) / BINS
        rows = [(k, float(((height - np.nan_to_num(f(middle))) ** 2).sum()), p) for k, (p, f) in _densities(s.m, s.v, s.lm, s.lv).items()]
    best = min(rows, key=lambda r: r[1])[0] if rows else None
    data = [(k, e, k == best, {a: float(b) for a, b in p.items()}, float(edge.lo), float(edge.hi)) for k, e, p in rows]
    return df.sparkSession.createDataFrame(data, "family string, sse double, best boolean, parameters map<string,double>, low double, high double")


def sample(spark, fitted: DataFrame, n: int, seed: int) -> DataFrame:
    """row_id and value: n values of the best family, by its inverse distribution function where it has a closed form."""
    r = fitted.filter("best").first()
    p, key = r.parameters, F.col("row_id")
    u = F.least(F.greatest(uniform(seed, "fit", key), F.lit(1e-9)), F.lit(1 - 1e-9))
    if r.family == "normal":
        x: Column = p["mean"] + p["std"] * normal(seed, "fit", key)
    elif r.family == "lognormal":
        x = F.exp(p["mean"] + p["std"] * normal(seed, "fit", key))
    elif r.family == "uniform":
        x = u
    elif r.family == "exponential":
        x = -F.log(1 - u) / p["rate"]
    elif r.family == "weibull":
        x = p["scale"] * F.pow(-F.log(1 - u), F.lit(1 / p["shape"]))
    else:  # gamma, beta: their distribution function as a table
        grid = (np.arange(2000) + 0.5) / 2000 * (1 if r.family == "beta" else 4)
        log = (p["a"] - 1) * np.log(grid) + (p["b"] - 1) * np.log1p(-grid) if r.family == "beta" else (p["shape"] - 1) * np.log(grid) - grid / p["scale"]
        cdf = np.cumsum(np.exp(log - log.max()))
        table = np.interp(np.linspace(0, 1, 201), cdf / cdf[-1], grid)
        at = u * 200
        k = F.least(F.floor(at), F.lit(199)).cast("int")
        values = F.array(*[F.lit(float(v)) for v in table])
        x = F.get(values, k) + (F.get(values, k + 1) - F.get(values, k)) * (at - k)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return _slots(spark, n).select("row_id", (F.lit(r.low) + scaled * (r.high - r.low)).alias("value"))


def normal_scores(df: DataFrame, col: str, to: str) -> DataFrame:
    """df with the normal score of a value: the normal quantile of its average rank among n, (rank - 1/2) / n."""
    from .relate import average_ranks

    ranked = average_ranks(df, col, "rank_")
    n = df.agg(F.count(number(col)).alias("n_"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(to, normal_quantile((F.col("rank_") - 0.5) / F.col("n_"))).drop("rank_", "n_")


def kernel_density(df: DataFrame, col: str, points: int = 101, bandwidth: float = 0.2, fine: int = 32, reach: float = 8.0) -> DataFrame:
    """x, density: a Gaussian kernel density at ``points`` places from three kernel widths below the smallest value to three above the largest.

    A kernel is ``bandwidth`` standard deviations wide. Values are counted in bins of a ``fine``-th of that, each shared
    between its two edges by its place (off by about 1 / (8 * fine ** 2) of the curvature); a bin reaches the places
    within ``reach`` kernel widths, beyond which a kernel is below 1e-14. Nulls and values that aren't finite don't count;
    no row if fewer than two values differ.
    """
    x = number(col)
    values = df.select(F.when(F.abs(x) != float("inf"), x).alias("x_")).dropna()
    one = values.agg(F.count("x_").alias("n_"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_"), (F.stddev_samp("x_") * bandwidth).alias("h_")).filter("h_ > 0")
    one = one.withColumns({"start_": F.col("lo_") - 3 * F.col("h_"), "gap_": (F.col("hi_") - F.col("lo_") + 6 * F.col("h_")) / (points - 1)})
    at = (F.col("x_") - F.col("lo_")) / F.col("h_") * fine
    bins = values.crossJoin(F.broadcast(one)).groupBy(F.floor(at).alias("b_")).agg(F.count("*").alias("m_"), F.sum(at - F.floor(at)).alias("right_"))  # one row is broadcast
    edges = F.explode(F.array(F.struct(F.col("b_").alias("b"), (F.col("m_") - F.col("right_")).alias("w")), F.struct((F.col("b_") + 1).alias("b"), F.col("right_").alias("w"))))
    placed = bins.select(edges.alias("e")).select("e.b", "e.w").crossJoin(F.broadcast(one)).withColumn("at_", F.col("lo_") + F.col("b") * F.col("h_") / fine)
    first = F.greatest(F.lit(0), F.ceil((F.col("at_") - reach * F.col("h_") - F.col("start_")) / F.col("gap_")))
    last = F.least(F.lit(points - 1), F.floor((F.col("at_") + reach * F.col("h_") - F.col("start_")) / F.col("gap_")))
    met = placed.filter(first <= last).withColumn("i_", F.explode(F.sequence(first, last)))
    far = (F.col("start_") + F.col("i_") * F.col("gap_") - F.col("at_")) / F.col("h_")
    sums = met.groupBy("i_").agg(F.sum(F.col("w") * F.exp(-far * far / 2)).alias("s_"))
    places = df.sparkSession.range(points).withColumnRenamed("id", "i_").crossJoin(F.broadcast(one)).join(F.broadcast(sums), "i_", "left")  # points rows
    return places.select((F.col("start_") + F.col("i_") * F.col("gap_")).alias("x"), (F.coalesce("s_", F.lit(0.0)) / (F.col("n_") * F.col("h_") * math.sqrt(2 * math.pi))).alias("density"))


def sample_density(df: DataFrame, col: str, n: int, seed: int, bandwidth: float = 0.2) -> DataFrame:
    """row_id and value: n draws from the kernel density. Each takes a value by a position in the sorted column and moves it by a normal number.

    Positions come from 64 bits of a hash and are met in the running counts of distinct values, so nothing is sorted whole.
    Values that are null or not finite aren't drawn; with none there is no row.
    """
    x = number(col)
    counts = df.select(F.when(F.abs(x) != float("inf"), x).alias("value")).dropna().groupBy("value").agg(F.count("*").alias("n"))
    one = df.agg(F.count(F.when(F.abs(x) != float("inf"), x)).alias("total"), (F.coalesce(F.stddev_samp(F.when(F.abs(x) != float("inf"), x)), F.lit(0.0)) * bandwidth).alias("h")).first()
    slots, k = _slots(df.sparkSession, n if one.total else 0), F.col("row_id")
    u = uniform(seed, "kernel-row", k) + uniform(seed, "kernel-rest", k) / float(1 << 32)
    drawn = draw_category(slots, counts.withColumn("total", F.lit(one.total)), "value", u, most=0) if one.total else slots.withColumn("value", F.lit(None).cast("double"))
    return drawn.select("row_id", (F.col("value") + one.h * normal(seed, "kernel", k)).alias("value"))


def sample_categories(df: DataFrame, col: str, n: int, seed: int, most: int = 100_000) -> DataFrame:
    """row_id and value: n draws of col's values by their shares (nulls don't count); all null if there are none."""
    counts = df.filter(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("value")).agg(F.count("*").alias("n"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    slots = _slots(df.sparkSession, n)
    return draw_category(slots, counts, "value", uniform(seed, "category", F.col("row_id")), most).select("row_id", "value")


def resample(df: DataFrame, col: str, n: int, seed: int) -> DataFrame:
    """row_id and value: n values like those of col: texts and booleans by their shares, numbers by the best family, else by the kernel density."""
    from .profile import numeric_columns

    if col not in numeric_columns(df) or df.schema[col].dataType.typeName() == "boolean":
        return sample_categories(df, col, n, seed)
    fitted = fit(df, col)
    return sample(df.sparkSession, fitted, n, seed) if fitted.filter("best").take(1) else sample_density(df, col, n, seed)
