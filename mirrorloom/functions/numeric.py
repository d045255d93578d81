"""Numeric functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.profile import number
from ..rng import laplace, normal

# Life stages by their first year.
LIFE_STAGES = [(0, "Child"), (13, "Teen"), (18, "Young Adult"), (25, "Adult"), (65, "Senior")]


def coerce(c: Column) -> Column:
    """Text as a number, without thousands separators, currency and percent signs; null where it is none."""
    return F.regexp_replace(c, r"[,$% ]", "").try_cast("double")


def age_band(c: Column, width: int = 10, start: int = 0, end: int = 100, open_end: bool = True) -> Column:
    """a-b bands closed on the left. The last is open (as in 90+) unless open_end is False; outside: 'nan'."""
    low = (F.floor((c - start) / width) * width + start).cast("long")
    last = end - width
    band = F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))
    inside = F.when(low >= last, F.concat(F.lit(str(last)), F.lit("+"))).otherwise(band)
    return F.when(c.isNull() | (c < start), F.lit("nan")).when((c >= end) & F.lit(not open_end), F.lit("nan")).otherwise(inside)


def life_stage(c: Column, stages: list[tuple[int, str]] = LIFE_STAGES, end: int = 120) -> Column:
    """The label of the stage that an age lies in; outside: 'nan'."""
    out = F.lit("nan")
    for low, label in stages:
        out = F.when((c >= low) & (c < end), label).otherwise(out)
    return out


def generalize(df: DataFrame, col: str, to: str, levels: int = 3) -> DataFrame:
    """df with the interval (lo, hi] of equal widths that a value lies in.

    The lowest edge is a thousandth of the range below the minimum. Edges are rounded to whole numbers,
    or to as many digits (6 at most) as keep them apart, and written with one digit at least.
    """
    x = number(col)
    ends = df.agg(F.min(x).alias("lo_"), F.max(x).alias("hi_"))
    span = F.col("hi_") - F.col("lo_")
    edges = [F.col("lo_") - 0.001 * span, *[F.col("lo_") + i * (span / levels) for i in range(1, levels + 1)]]
    apart = lambda d: F.array_max(F.array(*[(F.bround(a, d) == F.bround(b, d)).cast("int") for a, b in zip(edges, edges[1:])])) == 0
    texts = [F.array(*[F.format_string(f"%.{max(1, d)}f", F.bround(e, d)) for e in edges]) for d in range(7)]
    written = F.coalesce(*[F.when(apart(d), texts[d]) for d in range(6)], texts[6])
    table = ends.select("lo_", "hi_", written.alias("e_"))
    place = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.when(span > 0, F.ceil((x - F.col("lo_")) / (span / levels)) - 1).otherwise(0))).cast("int")
    label = F.concat(F.lit("("), F.get("e_", place), F.lit(", "), F.get("e_", place + 1), F.lit("]"))
    return df.crossJoin(F.broadcast(table)).withColumn(to, F.when(x.isNotNull(), label)).drop("lo_", "hi_", "e_")


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with <col>_z: (x - mean) / population standard deviation; constant columns give 0."""
    stats = df.agg(*[f(number(c)).alias(f"{c}:{k}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.crossJoin(F.broadcast(stats))
    z = {f"{c}_z": F.when(F.col(f"`{c}:s`") > 0, (number(c) - F.col(f"`{c}:m`")) / F.col(f"`{c}:s`")).otherwise(number(c) * 0) for c in cols}
    return j.withColumns(z).drop(*stats.columns)


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with <col>_scaled in [0, 1]; constant columns give 0."""
    stats = df.agg(*[f(number(c)).alias(f"{c}:{k}") for c in cols for k, f in (("a", F.min), ("b", F.max))])
    j = df.crossJoin(F.broadcast(stats))
    span = lambda c: F.col(f"`{c}:b`") - F.col(f"`{c}:a`")
    s = {f"{c}_scaled": F.when(span(c) > 0, (number(c) - F.col(f"`{c}:a`")) / span(c)).otherwise(number(c) * 0) for c in cols}
    return j.withColumns(s).drop(*stats.columns)


def yeo_johnson(c: Column, lam: float) -> Column:
    """The power transform for a given parameter."""
    up = F.log1p(c) if abs(lam) < 1e-9 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if abs(lam - 2) < 1e-9 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, col: str, grid: list[float] | None = None) -> float:
    """The parameter of the grid with the greatest likelihood; one aggregation for the whole grid."""
    grid = grid or [g / 10 for g in range(-20, 41, 2)]
    x = number(col)
    row = df.filter(x.isNotNull()).agg(F.count("*").alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    best = [(-row.n / 2 * math.log(row[f"v{i}"]) + (g - 1) * row.j, g) for i, g in enumerate(grid) if row[f"v{i}"]]
    return max(best)[1] if best else 1.0


def laplace_noise(c: Column, sensitivity: float, epsilon: float, seed: int, *key: Column) -> Column:
    return c + laplace(sensitivity / epsilon, seed, "laplace", *key)


def gaussian_noise(c: Column, sensitivity: float, epsilon: float, seed: int, *key: Column, delta: float = 1e-5) -> Column:
    return c + normal(seed, "gaussian", *key) * (math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon)
