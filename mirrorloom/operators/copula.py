"""A Gaussian copula over numbers, times and categories, each with its nulls.

Behind each column stands a standard normal number. Nulls are its lowest interval; a number's ranks
or a category's sorted values follow. The correlations of these hidden numbers are fitted, so columns
of all kinds keep their relations, nulls included.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normal as gauss
from ..rng import normal
from ..written import discard, written
from .profile import number
from .relate import running

TERMS = 40  # of the series in r for a pair of categories


@dataclass
class Part:
    """One column: kind is number, time or category; marks are the quantiles of its values, spans a category's intervals."""

    name: str
    kind: str
    type: T.DataType
    nulls: float = 0.0
    marks: list[float] = field(default_factory=list)
    spans: DataFrame | None = None
    terms: np.ndarray | None = None


@dataclass
class Model:
    spark: SparkSession
    parts: list[Part]
    rows: int
    correlations: np.ndarray


def _kind(of: T.DataType) -> str:
    if isinstance(of, T.NumericType):
        return "number"
    if isinstance(of, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(of, (T.StringType, T.BooleanType)):
        return "category"
    raise ValueError(f"a copula takes numbers, times, texts and booleans, not {of.simpleString()}")


def _value(part: Part) -> Column:
    """The column as a finite double (a date in days, a time in seconds) or as text."""
    c = F.col(f"`{part.name}`")
    if part.kind == "category":
        return c.cast("string")
    if part.kind == "number":
        x = number(part.name)
        return F.when(F.abs(x) != float("inf"), x)
    return F.unix_date(c).cast("double") if isinstance(part.type, T.DateType) else c.cast("timestamp").cast("double")


def _restored(part: Part, x: Column) -> Column:
    """A double as a value of the column's type."""
    if part.kind == "time":
        return F.date_from_unix_date(F.round(x).cast("int")) if isinstance(part.type, T.DateType) else F.timestamp_seconds(x).cast(part.type)
    return F.round(x).cast(part.type) if isinstance(part.type, T.IntegralType) else x.cast(part.type)


def _spans(df: DataFrame, part: Part, rows: int) -> DataFrame:
    """value, n, before, total, low, high, score: a category's share of the hidden number, from low to high, and its mean there; written."""
    counts = df.groupBy(_value(part).alias("value")).agg(F.count("*").alias("n"))
    at = running(counts, "value", ["n"]).select("value", "n", F.col("before_n").alias("before"), F.lit(rows).cast("long").alias("total"))
    at = at.withColumns({"low": F.col("before") / F.col("total"), "high": (F.col("before") + F.col("n")) / F.col("total")})
    mass = gauss.density(gauss.quantile(F.col("low"))) - gauss.density(gauss.quantile(F.col("high")))
    return written(at.withColumn("score", mass * F.col("total") / F.col("n")), "spans")


def _terms(spans: DataFrame) -> np.ndarray:
    """E[h_k(z) score(z)] for the normalised Hermite polynomials h_1 to h_TERMS: sums over the categories, in each task first."""

    def sums(batches):
        total = np.zeros(TERMS)
        for t in batches:
            z = gauss.quantiles(t[["low", "high"]].to_numpy())
            mass = np.where(np.isfinite(z), np.exp(-z * z / 2), 0.0) / np.sqrt(2 * np.pi)
            z = np.where(np.isfinite(z), z, 0.0)
            before, h = np.zeros_like(z), np.ones_like(z)
            for k in range(1, TERMS + 1):  # the integral of h_k times the density is -h_(k-1) times the density, over the root of k
                each = (h * mass) @ np.array([1.0, -1.0]) / np.sqrt(k)
                total[k - 1] += float(each @ t["score"].to_numpy())
                before, h = h, (z * h - np.sqrt(k - 1) * before) / np.sqrt(k)
        yield pd.DataFrame({"k": np.arange(TERMS), "v": total})

    found = spans.select("low", "high", "score").mapInPandas(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # TERMS rows
    return np.array([r.v for r in sorted(found)] or [0.0] * TERMS)


def _scores(x: np.ndarray, part: Part, rows: int) -> np.ndarray:
    """The hidden number of each value of a number or time: by its rank between the marks; nulls take the mean of their interval."""
    marks = np.array(part.marks)
    distinct, first, times = np.unique(marks, return_index=True, return_counts=True)
    middle = (first + (times - 1) / 2) / max(1, len(marks) - 1)
    held = max(1.0, rows * (1 - part.nulls))
    u = np.clip(np.interp(x, distinct, middle), 0.5 / held, 1 - 0.5 / held)
    edge = float(gauss.quantiles(np.array(part.nulls)))
    empty = -np.exp(-edge * edge / 2) / np.sqrt(2 * np.pi) / part.nulls if 0 < part.nulls < 1 else 0.0
    return np.where(np.isnan(x), empty, gauss.quantiles(part.nulls + (1 - part.nulls) * u))


def _covariances(df: DataFrame, parts: list[Part], rows: int) -> np.ndarray:
    """The scores' covariances over one scan: each task adds up products of whole batches, one row a product meets in the end."""
    for i, p in enumerate(parts):
        if p.kind == "category":
            scores = p.spans.select(F.col("value").alias(f"value_{i}"), F.col("score").alias(f"s{i}"))
            df = df.join(scores, _value(p).eqNullSafe(F.col(f"value_{i}")))
    size = len(parts)
    plain = [(p.kind, Part(p.name, p.kind, p.type, p.nulls, p.marks)) for p in parts]

    def products(batches):
        total, sums, squares = 0, np.zeros(size), np.zeros((size, size))
        for t in batches:
            columns = [t[f"x{i}"].to_numpy(dtype="float64", na_value=np.nan) for i in range(size)]
            z = np.column_stack([c if kind == "category" else np.zeros(len(c)) if not p.marks else _scores(c, p, rows) for c, (kind, p) in zip(columns, plain)])
            total, sums, squares = total + len(z), sums + z.sum(0), squares + z.T @ z
        yield pd.DataFrame({"place": np.arange(1 + size + size * size), "v": np.concatenate([[total], sums, squares.ravel()])})

    values = df.select(*[(F.col(f"s{i}") if p.kind == "category" else _value(p)).alias(f"x{i}") for i, p in enumerate(parts)])
    found = values.mapInPandas(products, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()  # columns squared
    v = np.array([r.v for r in sorted(found)] or np.zeros(1 + size + size * size))
    mean = v[1 : 1 + size] / max(1.0, v[0])
    return v[1 + size :].reshape(size, size) / max(1.0, v[0]) - np.outer(mean, mean)


def _correlation(seen: float, a: np.ndarray, b: np.ndarray) -> float:
    """The r whose scores have the covariance seen: the sum of a_k b_k r ** k, which grows with r, by bisection."""
    if a[0] * b[0] < 1e-12:
        return 0.0
    powers = np.arange(1, TERMS + 1)
    low, high = -0.999, 0.999
    for _ in range(40):
        r = (low + high) / 2
        low, high = (r, high) if float((a * b) @ r**powers) < seen else (low, r)
    return (low + high) / 2


def fit(df: DataFrame, cols: list[str], points: int = 1001) -> Model:
    """The copula of cols. One aggregation gives all quantiles, one scan all pairs' covariances; each category adds its value counts.

    Scores of intervals vary less than the number behind them, so their covariances are smaller; the fit undoes this:
    exactly for categories, for numbers as far as ties are concerned by their variance. Nulls and values that aren't finite are one interval.
    Repeated rows count each. An empty table gives a model of nulls; columns of one value have no correlation.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [Part(c, _kind(types[c]), types[c]) for c in cols]
    df = df.select(*[F.col(f"`{c}`") for c in cols])
    shares = [i / (points - 1) for i in range(points)]
    measured = [(i, p) for i, p in enumerate(parts) if p.kind != "category"]
    one = df.agg(F.count("*").alias("rows"), *[F.percentile_approx(_value(p), shares, 10 * points).alias(f"q{i}") for i, p in measured], *[F.count(_value(p)).alias(f"n{i}") for i, p in measured]).first()
    for i, p in measured:
        p.nulls, p.marks = (1 - one[f"n{i}"] / one.rows if one.rows else 1.0), [float(m) for m in one[f"q{i}"] or []]
    for p in parts:
        if p.kind == "category":
            p.spans = _spans(df, p, one.rows)
            p.terms = _terms(p.spans)
    seen = _covariances(df, parts, one.rows)
    for i, p in measured:
        p.terms = np.concatenate([[max(0.0, seen[i, i])], np.zeros(TERMS - 1)])
    out = np.eye(len(parts))
    for i, j in combinations(range(len(parts)), 2):
        out[i, j] = out[j, i] = _correlation(float(seen[i, j]), parts[i].terms, parts[j].terms)
    return Model(df.sparkSession, parts, one.rows, out)


def sample(model: Model, n: int, seed: int) -> DataFrame:
    """row_id and n rows: normal numbers with the model's correlations, from hashes of row_id, and for each column the value at their share."""
    from .generate import _slots, draw_category

    parts, size = model.parts, len(model.parts)
    values, vectors = np.linalg.eigh(model.correlations)
    near = vectors @ np.diag(np.clip(values, 1e-6, None)) @ vectors.T
    low = np.linalg.cholesky(near / np.sqrt(np.outer(np.diag(near), np.diag(near))))
    out = _slots(model.spark, n).select("row_id", *[normal(seed, f"copula-{i}", F.col("row_id")).alias(f"z{i}") for i in range(size)])
    out = out.select("row_id", *[gauss.share_below(sum((float(low[i, j]) * F.col(f"z{j}") for j in range(i + 1)), F.lit(0.0))).alias(f"u{i}") for i in range(size)])
    marks = model.spark.createDataFrame([tuple(p.marks for p in parts)], ", ".join(f"q{i} array<double>" for i in range(size)))  # one row
    out = out.crossJoin(F.broadcast(marks))
    for i, p in enumerate(parts):
        u, to = F.col(f"u{i}"), f"made_{i}"
        if p.kind == "category":
            drawn = draw_category(out, p.spans.select("value", "n", "total"), to, u) if model.rows else out.withColumn(to, F.lit(None).cast("string"))
            out = drawn.withColumn(to, F.col(to).cast(p.type))
            continue
        at = (u - p.nulls) / max(1e-12, 1 - p.nulls) * (len(p.marks) - 1)
        k = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(max(0, len(p.marks) - 2)))).cast("int")
        a, b = F.get(f"q{i}", k), F.get(f"q{i}", F.least(k + 1, F.lit(max(0, len(p.marks) - 1))))
        out = out.withColumn(to, _restored(p, F.when(u >= p.nulls, a + (b - a) * (at - k))) if p.marks else F.lit(None).cast(p.type))
    return out.select("row_id", *[F.col(f"made_{i}").alias(p.name) for i, p in enumerate(parts)])


def release(model: Model) -> None:
    """Remove the model's tables, once all rows drawn from it are written."""
    discard(*[p.spans for p in model.parts if p.spans is not None])
