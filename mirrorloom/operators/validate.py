"""Validation: constraints, schema checks and anomalies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import fences_row, number


@dataclass(frozen=True)
class Constraint:
    """kind: range (low, high), not_null, regex (pattern, from the start), unique, equals (other column)."""

    column: str
    kind: str
    params: dict = field(default_factory=dict)


def check_constraints(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """column, kind, violations: one aggregation for all but unique, which counts values first."""
    counted, unique = [], []
    for c in constraints:
        x, p = F.col(f"`{c.column}`"), c.params
        if c.kind == "range":
            bad = (x < p["low"]) | (x > p["high"])
        elif c.kind == "not_null":
            bad = x.isNull()
        elif c.kind == "regex":
            bad = ~x.cast("string").rlike(f"^(?:{p['pattern']})")
        elif c.kind == "equals":
            bad = ~x.eqNullSafe(F.col(f"`{p['other']}`"))
        elif c.kind == "unique":
            unique.append(c)
            continue
        else:
            raise ValueError(f"unknown constraint {c.kind}")
        counted.append((c, F.count_if(bad)))
    out = None
    if counted:
        one = df.agg(*[e.alias(f"v{i}") for i, (_, e) in enumerate(counted)])
        rows = F.array(*[F.struct(F.lit(c.column).alias("column"), F.lit(c.kind).alias("kind"), F.col(f"v{i}").alias("violations")) for i, (c, _) in enumerate(counted)])
        out = one.select(F.explode(rows).alias("r")).select("r.*")
    for c in unique:
        repeats = df.groupBy(c.column).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("violations"))
        own = repeats.select(F.lit(c.column).alias("column"), F.lit("unique").alias("kind"), "violations")
        out = own if out is None else out.unionByName(own)
    return out


def check_schema(df: DataFrame, expected: dict[str, str]) -> list[dict]:
    """Missing, extra and differently typed columns."""
    have = dict(df.dtypes)
    out = [{"column": c, "issue": "missing"} for c in expected if c not in have]
    out += [{"column": c, "issue": "extra"} for c in have if c not in expected]
    return out + [{"column": c, "issue": f"type {have[c]}, not {t}"} for c, t in expected.items() if c in have and have[c] != t]


def anomalies(df: DataFrame, cols: list[str], key: list[str], reference: DataFrame | None = None, factor: float = 3.0, exact: bool = True) -> DataFrame:
    """key columns, column, value: values beyond the fences of the reference (df itself without one)."""
    fences = fences_row(df if reference is None else reference, cols, factor, exact)
    j = df.crossJoin(F.broadcast(fences))
    long = j.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value"), F.col(f"`{c}_low`").alias("lo"), F.col(f"`{c}_high`").alias("hi")) for c in cols])).alias("x"))
    return long.filter((F.col("x.value") < F.col("x.lo")) | (F.col("x.value") > F.col("x.hi"))).select(*key, "x.column", "x.value")


def correlation_anomalies(df: DataFrame, a: str, b: str, least: float = 0.7) -> DataFrame:
    """Rows whose standardised values contradict a strong correlation of a and b."""
    s = df.agg(F.corr(number(a), number(b)).alias("r_"), *[f(number(c)).alias(f"{k}_{c}") for c in (a, b) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    j = df.crossJoin(F.broadcast(s))
    z = lambda c: (number(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    up = (F.col("r_") > least) & (z(a) * z(b) < -1) & (F.abs(z(a) - z(b)) > 3)
    down = (F.col("r_") < -least) & (z(a) * z(b) > 1) & (F.abs(z(a) + z(b)) > 3)
    return j.filter(up | down).select(*df.columns)


def warnings(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, nulls, extremes: missing values, and values beyond three times the quartile range."""
    from .profile import _wide, outlier_counts

    nulls = _wide(df, cols, lambda c: {"nulls": F.count_if(F.col(f"`{c}`").isNull())})
    return nulls.join(F.broadcast(outlier_counts(df, cols, 3.0).withColumnRenamed("outliers", "extremes")), "column")


def ddl(df: DataFrame, table: str, dialect: str = "sqlite", keys: dict[str, str] | None = None) -> str:
    """CREATE TABLE with an id; keys: column -> table(column) it refers to."""
    number_id = {"sqlite": "INTEGER PRIMARY KEY AUTOINCREMENT", "postgresql": "SERIAL PRIMARY KEY", "mysql": "INTEGER PRIMARY KEY AUTO_INCREMENT"}[dialect]
    kind = lambda t: "FLOAT" if isinstance(t, T.NumericType) else "TIMESTAMP" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "VARCHAR(255)"
    lines = [f"  id {number_id}", *[f'  "{f.name}" {kind(f.dataType)}' for f in df.schema.fields if f.name != "id"]]
    lines += [f'  FOREIGN KEY ("{c}") REFERENCES {to}' for c, to in (keys or {}).items()]
    return f'CREATE TABLE "{table}" (\n' + ",\n".join(lines) + "\n);"
