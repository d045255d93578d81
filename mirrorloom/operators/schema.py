"""Semantic schemas inferred from data: one pass of aggregates, then rules on the driver over one row a column."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import ADDRESS_NAMES, column_basics, contact_measures, number, numeric_columns


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    kind: str  # numeric, datetime, categorical, email, phone, address, text, unknown
    subtype: str | None  # id, name, age
    nullable: bool
    unique: bool
    distinct: int
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class TableSchema:
    rows: int
    columns: dict[str, ColumnInfo] = field(default_factory=dict)

    def keys(self) -> list[str]:
        """Candidates of the primary key: unique, without nulls."""
        return [c for c, i in self.columns.items() if i.unique and not i.nullable]

    def of_kind(self, *kinds: str) -> list[str]:
        return [c for c, i in self.columns.items() if i.kind in kinds]

    def to_dict(self) -> dict:
        return asdict(self)


def infer(df: DataFrame, share: float = 0.1) -> TableSchema:
    """The schema of a table. A text column is categorical if its distinct values are under ``share`` of the rows or at most 20."""
    basics = {r.column: r for r in column_basics(df).collect()}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = numeric_columns(df)
    aggs = [m.alias(f"{k.removesuffix('_ratio')}:{c}") for c in texts for k, m in contact_measures(c).items()]
    aggs += [F.avg(F.try_to_timestamp(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"date:{c}") for c in texts]
    aggs += [f(number(c)).alias(f"{k}:{c}") for c in numbers for k, f in (("low", F.min), ("high", F.max))]
    row = df.agg(*aggs, F.count("*").alias(":rows")).first()
    out = {}
    for f in df.schema.fields:
        b, name = basics.get(f.name), f.name.lower()
        ratio = lambda k: row[f"{k}:{f.name}"] or 0.0  # noqa: B023, E731
        distinct = b.distinct if b else 0
        unique = bool(b and b.distinct == b.rows)
        if f.name in numbers:
            kind = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind = "datetime"
        elif f.name not in texts:
            kind = "unknown"
        elif ratio("date") > 0.8:
            kind = "datetime"
        elif ratio("email") > 0.8:
            kind = "email"
        elif ratio("phone") > 0.7:
            kind = "phone"
        elif b and distinct <= 20:
            kind = "categorical"
        elif ratio("address") > 0.3 or any(k in name for k in ADDRESS_NAMES):
            kind = "address"
        else:
            kind = "categorical" if b and distinct < share * b.rows else "text"
        low, high = (row[f"low:{f.name}"], row[f"high:{f.name}"]) if kind == "numeric" else (None, None)
        subtype = "id" if (name.endswith(("id", "key")) and unique) else "name" if "name" in name and "filename" not in name else "age" if kind == "numeric" and name.split("_")[-1] == "age" else None
        out[f.name] = ColumnInfo(f.name, kind, subtype, bool(b and b.nulls), unique, distinct, low, high)
    return TableSchema(row[":rows"], out)


def schema_table(df: DataFrame) -> DataFrame:
    """column, kind, subtype, nullable, unique, distinct: the inferred schema as a table."""
    rows = [(c.name, c.kind, c.subtype, c.nullable, c.unique, c.distinct) for c in infer(df).columns.values()]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, subtype string, nullable boolean, unique boolean, distinct long")


# Parts of names that mark personal data.
SENSITIVE = "name email phone address ssn birth age gender income salary credit password account".split()


def sensitive_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(k in c.lower() for k in SENSITIVE)]


def column_constraints(df: DataFrame, cols: list[str], most: int = 20) -> DataFrame:
    """column, low, high, allowed (the most frequent texts, joined by |), nullable: what a look-alike must keep to."""
    from .profile import _wide, top_values

    numbers = [c for c in cols if c in numeric_columns(df)]
    texts = [c for c in cols if c not in numbers]
    out = _wide(df, cols, lambda c: {"low": F.min(number(c)) if c in numbers else F.lit(None).cast("double"), "high": F.max(number(c)) if c in numbers else F.lit(None).cast("double"), "nullable": F.count_if(F.col(f"`{c}`").isNull()) > 0})
    if not texts:
        return out.withColumn("allowed", F.lit(None).cast("string"))
    allowed = top_values(df, texts, most).groupBy("column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), "|").alias("allowed"))
    return out.join(F.broadcast(allowed), "column", "left")


def repair(df: DataFrame, expected: TableSchema, share: float = 0.8) -> TableSchema:
    """The schema brought to the data: new columns added; columns of which under ``share`` parse as their kind become text."""
    from dataclasses import replace

    own = infer(df)
    out = {}
    for c, info in own.columns.items():
        old = expected.columns.get(c)
        if old is None or old.kind == info.kind:
            out[c] = old or info
            continue
        x = F.col(f"`{c}`").cast("string")
        parses = {"numeric": x.try_cast("double"), "datetime": F.try_to_timestamp(x)}.get(old.kind)
        ratio = df.filter(x.isNotNull()).agg(F.avg(parses.isNotNull().cast("double"))).first()[0] if parses is not None else 1.0
        out[c] = old if (ratio or 0.0) >= share else replace(old, kind=info.kind)
    return TableSchema(own.rows, out)
