"""The whole job over a set of tables: load, infer, clean, generate, repair, evaluate, validate, write."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, compare, generate, schema, validate
from ..operators.profile import numeric_columns
from ..sources import readers, writers


@dataclass(frozen=True)
class Config:
    """What to do with each table. actions: table -> column -> synthesize (default) or copy; masks: table -> column -> method."""

    method: str = "perturb"
    rows: int | None = None
    seed: int = 42
    factor: float = 0.2
    keys: dict[str, list[str]] = field(default_factory=dict)
    actions: dict[str, dict[str, str]] = field(default_factory=dict)
    masks: dict[str, dict[str, str]] = field(default_factory=dict)
    age_columns: dict[str, str] = field(default_factory=dict)
    constraints: dict[str, list[validate.Constraint]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.method not in generate.GENERATORS:
            raise ValueError(f"unknown method {self.method}")
        if not 0 <= self.factor <= 1:
            raise ValueError("factor must lie in [0, 1]")
        for table, actions in self.actions.items():
            if unknown := set(actions.values()) - {"synthesize", "copy"}:
                raise ValueError(f"unknown actions for {table}: {', '.join(sorted(unknown))}")


def load_config(path: str, **changes) -> Config:
    """A Config from a JSON file; what the file leaves out keeps its default, and changes go before the file."""
    given = json.loads(Path(path).read_text(encoding="utf-8")) | changes
    if unknown := set(given) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    rules = {t: [r if isinstance(r, validate.Constraint) else validate.Constraint(**r) for r in rs] for t, rs in given.get("constraints", {}).items()}
    return Config(**(given | {"constraints": rules}))


@dataclass
class Result:
    original: dict[str, DataFrame]
    synthetic: dict[str, DataFrame]
    schemas: dict[str, schema.TableSchema]
    scores: dict[str, DataFrame]
    violations: dict[str, DataFrame]


def run_tables(tables: dict[str, DataFrame], config: Config) -> Result:
    out = Result({}, {}, {}, {}, {})
    for name, df in tables.items():
        if not df.columns or not df.limit(1).count():
            raise ValueError(f"table {name} is empty")
        own = clean.preprocess(df)
        info = schema.infer(own)
        key = config.keys.get(name) or info.keys()[:1]
        if not key:
            raise ValueError(f"table {name} has no key; name one in Config.keys")
        made = generate.generate(own, config.method, key, config.rows, config.seed, config.factor)
        copied = [c for c, action in config.actions.get(name, {}).items() if action == "copy" and c not in key]
        made = generate.copy_columns(made, own, key, copied, config.seed)
        row_key = ["row_id"] if "row_id" in made.columns else key
        if name in config.masks:
            made = generate.mask(made, config.masks[name], row_key, config.seed)
        numeric = [c for c in numeric_columns(own) if c in made.columns and c not in key]
        categorical = [c for c in info.of_kind("categorical") if c in made.columns]
        out.original[name], out.synthetic[name], out.schemas[name] = own, made, info
        if numeric or categorical:
            out.scores[name] = compare.quality_score(own, made, numeric, categorical)
        if name in config.constraints:
            out.violations[name] = validate.check_constraints(made, config.constraints[name])
    return out


def run(spark: SparkSession, source: str, target: str, config: Config = Config(), format: str = "parquet") -> Result:
    """Read a source, make look-alikes, write them with a manifest."""
    result = run_tables(readers.load(spark, source), config)
    manifest = {"method": config.method, "seed": config.seed, "schemas": {k: v.to_dict() for k, v in result.schemas.items()}}
    writers.write({f"synthetic_{k}": v for k, v in result.synthetic.items()}, target, format, "overwrite", manifest if format in ("parquet", "csv", "json", "orc") else None)
    return result
