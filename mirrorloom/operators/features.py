"""Fitted transforms: what a table taught is kept as a few numbers, applied to other tables, and undone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fit_yeo_johnson, yeo_johnson
from .clean import modes
from .profile import exact_percentiles, number, value_counts

#: A column of more values isn't one-hot encoded.
MOST_VALUES = 1000
#: A column as skewed as this is power-transformed.
SKEWED = 1.0


@dataclass(frozen=True)
class Numbers:
    """What is known of a numeric column: its fill, fences, power (None: as it is), and the mean and deviation after all that."""

    fill: float
    low: float
    high: float
    power: float | None
    mean: float
    deviation: float


@dataclass(frozen=True)
class Features:
    numbers: dict[str, Numbers]
    values: dict[str, list[str]]
    fills: dict[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Numbers filled, clipped, power-transformed and standardised; a 0/1 column for each value of a category. Unseen values give only zeros."""
        out = {c: (_power(_clipped(c, n), n.power) - n.mean) / (n.deviation or 1.0) for c, n in self.numbers.items()}
        out |= {f"{c}_{v}": (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.fills[c])) == v).cast("int") for c, vs in self.values.items() for v in vs}
        return df.withColumns(out).drop(*self.values)

    def inverse(self, df: DataFrame) -> DataFrame:
        """The columns as they were, filled and clipped; a category whose columns are all zero is null."""
        back = {c: _unpower(F.col(f"`{c}`") * (n.deviation or 1.0) + n.mean, n.power) for c, n in self.numbers.items()}
        for c, vs in self.values.items():
            best = F.array_max(F.array(*[F.struct(F.col(f"`{c}_{v}`").alias("x"), F.lit(-i).alias("i")) for i, v in enumerate(vs)]))
            back[c] = F.when(best["x"] > 0, F.get(F.array(*map(F.lit, vs)), -best["i"]))
        return df.withColumns(back).drop(*[f"{c}_{v}" for c, vs in self.values.items() for v in vs])


def _clipped(c: str, n: Numbers):
    return F.greatest(F.lit(n.low), F.least(F.lit(n.high), F.coalesce(number(c), F.lit(n.fill))))


def _power(x, power: float | None):
    return x if power is None else yeo_johnson(x, power)


def _unpower(y, power: float | None):
    if power is None:
        return y
    up = F.expm1(y) if abs(power) < 1e-9 else F.pow(y * power + 1, F.lit(1 / power)) - 1
    down = -F.expm1(-y) if abs(power - 2) < 1e-9 else 1 - F.pow(1 - (2 - power) * y, F.lit(1 / (2 - power)))
    return F.when(y >= 0, up).otherwise(down)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], factor: float = 1.5) -> Features:
    """Learn fills (median, mode), fences, powers of skewed columns, means and deviations, and the values of categories; a few numbers each."""
    quartiles = {r.column: r.q for r in exact_percentiles(df, {c: number(c) for c in numeric}, [0.25, 0.5, 0.75]).collect()} if numeric else {}
    known = {}
    for c in numeric:
        q1, q2, q3 = quartiles[c] or (0.0, 0.0, 0.0)
        known[c] = Numbers(q2, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1), None, 0.0, 1.0)
    if known:
        filled = df.select(*[_clipped(c, n).alias(c) for c, n in known.items()])
        skew = filled.agg(*[F.skewness(F.col(f"`{c}`")).alias(c) for c in known]).first()
        powers = {c: fit_yeo_johnson(filled, c) if abs(skew[c] or 0.0) > SKEWED else None for c in known}
        row = filled.agg(*[f(_power(F.col(f"`{c}`"), powers[c])).alias(f"{k}:{c}") for c in known for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        known = {c: Numbers(n.fill, n.low, n.high, powers[c], row[f"m:{c}"] or 0.0, row[f"s:{c}"] or 0.0) for c, n in known.items()}
    values, fills = {}, {}
    for c in categorical:
        found = [r.value for r in value_counts(df, [c]).select("value").orderBy("value").limit(MOST_VALUES + 1).collect()]
        if len(found) > MOST_VALUES:
            raise ValueError(f"{c} has over {MOST_VALUES} values")
        values[c] = found
        mode = modes(df, [c]).first()
        fills[c] = mode["mode"] if mode else "Unknown"
    return Features(known, values, fills)


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and missing cells before and after a cleaning, rows and columns dropped."""

    def sizes(df: DataFrame, k: str) -> DataFrame:
        missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
        return df.agg(F.count("*").alias(f"rows_{k}"), missing.alias(f"missing_{k}"))

    one = sizes(before, "before").crossJoin(F.broadcast(sizes(after, "after")))
    dropped = len(set(before.columns) - set(after.columns))
    return one.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"), "missing_before", "missing_after", F.lit(dropped).cast("long").alias("columns_dropped"))
