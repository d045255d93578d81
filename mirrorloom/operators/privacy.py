"""Privacy models: k-anonymity, l-diversity, differential privacy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import generalize
from ..rng import laplace
from .profile import column_basics, histogram, number, numeric_columns

# The levels of anonymisation.
PRESETS = {"minimal": {"k": 3, "epsilon": 2.0}, "balanced": {"k": 5, "l": 2, "epsilon": 1.0}, "high": {"k": 10, "l": 3, "epsilon": 0.5}}


def quasi_identifiers(df: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """column, distinct_ratio: columns that are neither constant nor unique."""
    return column_basics(df).filter((F.col("distinct_ratio") > low) & (F.col("distinct_ratio") < high)).select("column", "distinct_ratio")


def _sized(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with group_size_, the rows of a group of keys (null if a key is null). Counted first and joined, so no group meets in one task."""
    counts = df.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("group_size_"))
    return df.join(counts, keys, "left")


def anonymity_level(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: k (the smallest group), groups, and risk = exp(-k / 2) below 5, else 0."""
    counts = df.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("n"))
    one = counts.agg(F.min("n").alias("k"), F.count("*").alias("groups"))
    return one.withColumn("risk", F.when(F.col("k") < 5, F.exp(-F.col("k") / 2.0)).otherwise(0.0))


def suppress_small_groups(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows of groups of fewer than k go; rows with a null key belong to no group and stay."""
    return _sized(df, keys).filter(F.col("group_size_").isNull() | (F.col("group_size_") >= k)).select(*df.columns)


def rare_to_other(df: DataFrame, col: str, k: int) -> DataFrame:
    """Values of fewer than k rows become 'Other'."""
    return _sized(df, [col]).withColumn(col, F.when(F.col("group_size_") < k, "Other").otherwise(F.col(col))).select(*df.columns)


def generalize_by(df: DataFrame, col: str, mapping: dict[str, str] | DataFrame, other: str | None = None) -> DataFrame:
    """col by a dictionary (a dict, or a table of value and general); values without an entry become ``other``, or stay where it is None."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), "value string, general string") if isinstance(mapping, dict) else mapping.select("value", "general")
    looked = df.join(table.select(F.col("value").alias("value_"), F.col("general").alias("general_")), F.col(f"`{col}`").cast("string") == F.col("value_"), "left")
    rest = F.col(f"`{col}`").cast("string") if other is None else F.when(F.col(f"`{col}`").isNotNull(), other)
    return looked.withColumn(col, F.coalesce("general_", rest)).select(*[F.col(f"`{c}`") for c in df.columns])


def k_anonymize(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Numeric keys as intervals, rare values as 'Other', then small groups suppressed."""
    out = df
    for c in keys:
        out = generalize(out, c, c) if c in numeric_columns(df) else rare_to_other(out, c, k)
    return suppress_small_groups(out.select(*df.columns), keys, k)


def l_diverse(df: DataFrame, keys: list[str], sensitive: list[str], least: int) -> DataFrame:
    """Rows of groups in which each sensitive column has at least ``least`` values; rows with a null key go."""
    counts = df.dropna(subset=keys).groupBy(*keys).agg(*[F.count_distinct(s).alias(f"d_{s}") for s in sensitive])
    good = counts.filter(reduce(lambda a, b: a & b, [F.col(f"d_{s}") >= least for s in sensitive])).select(*keys)
    return df.join(good, keys, "left_semi").select(*df.columns)


class BudgetExceeded(ValueError):
    """A mechanism asked for more epsilon than is left."""


class Budget:
    """The epsilon that mechanisms over the same rows may spend together.

    Sequential composition: draws add up. Parallel composition: draws of the same ``disjoint`` name, made over different ``part``s
    of the rows that share none, cost the largest total of a part. A draw beyond the limit raises before anything is spent.
    """

    def __init__(self, epsilon: float) -> None:
        if not epsilon > 0:
            raise ValueError("epsilon must be positive")
        self.epsilon = epsilon
        self.draws: list[tuple[str, str | None, str | None, float]] = []

    @staticmethod
    def _cost(draws: list[tuple[str, str | None, str | None, float]]) -> float:
        parts: dict[tuple, float] = {}
        for i, (_, disjoint, part, epsilon) in enumerate(draws):
            key = (i, None) if disjoint is None else (disjoint, part)
            parts[key] = parts.get(key, 0.0) + epsilon
        largest: dict = {}
        for (family, _), epsilon in parts.items():
            largest[family] = max(largest.get(family, 0.0), epsilon)
        return sum(largest.values())

    @property
    def spent(self) -> float:
        return self._cost(self.draws)

    @property
    def left(self) -> float:
        return max(0.0, self.epsilon - self.spent)

    def draw(self, epsilon: float, what: str, disjoint: str | None = None, part: str | None = None) -> float:
        """Spends epsilon on the mechanism ``what`` and returns it."""
        if not epsilon > 0:
            raise ValueError("epsilon must be positive")
        draws = [*self.draws, (what, disjoint, part, float(epsilon))]
        if self._cost(draws) > self.epsilon * (1 + 1e-9):  # a sum of shares may round up
            raise BudgetExceeded(f"{what} asks for {epsilon}, {self.left} of {self.epsilon} is left")
        self.draws = draws
        return epsilon

    def report(self, spark: SparkSession) -> DataFrame:
        """what, disjoint, part, epsilon of each draw in its order, and spent, the budget gone after it."""
        rows = [(*d, self._cost(self.draws[: i + 1])) for i, d in enumerate(self.draws)]
        return spark.createDataFrame(rows, "what string, disjoint string, part string, epsilon double, spent double")


def private_means(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float, seed: int, by: str | None = None, budget: Budget | None = None) -> DataFrame:
    """column, (by,) n, private_mean, epsilon: means of values clipped to each column's declared bounds, with Laplace noise.

    The columns share epsilon evenly, as they are of the same rows. Groups share no rows, so each has a column's whole share. Nulls don't
    count; a column (of a group) without values has n 0 and no mean; null is a group of its own. One aggregation serves all columns.
    """
    share = epsilon / len(bounds)
    if budget is not None:
        budget.draw(epsilon, f"means of {', '.join(bounds)}")
    clipped = {c: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number(c))) for c, (low, high) in bounds.items()}
    keys = [F.col(f"`{by}`").alias("by_")] if by else []
    one = df.select(*keys, *[F.when(number(c).isNotNull(), x).alias(f"x{i}") for i, (c, x) in enumerate(clipped.items())])
    one = (one.groupBy("by_") if by else one.groupBy()).agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(bounds)) for k, f in (("n", F.count), ("m", F.avg))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m_"), F.lit(float(high - low)).alias("span_")) for i, (c, (low, high)) in enumerate(bounds.items())]))
    rows = one.select(*(["by_"] if by else []), each.alias("r")).select(*(["by_"] if by else []), "r.*")
    noise = laplace(F.col("span_") / F.col("n") / share, seed, "mean", F.col("column"), *([F.coalesce(F.col("by_").cast("string"), F.lit("null"))] if by else []))
    mean = F.when(F.col("n") > 0, F.col("m_") + noise)
    return rows.select("column", *([F.col("by_").alias(by)] if by else []), "n", mean.alias("private_mean"), F.lit(share).alias("epsilon"))


def private_histogram(df: DataFrame, col: str, epsilon: float, seed: int, bins: int = 10, budget: Budget | None = None) -> DataFrame:
    """bin, low, high, n: counts with Laplace noise, at least 0; a row is in one bin, so all bins share epsilon."""
    if budget is not None:
        budget.draw(epsilon, f"histogram of {col}")
    return histogram(df, col, bins).withColumn("n", F.greatest(F.lit(0.0), F.col("n") + laplace(1.0 / epsilon, seed, "histogram", F.col("bin"))))


def private_mean(df: DataFrame, col: str, low: float, high: float, epsilon: float, seed: int, budget: Budget | None = None) -> DataFrame:
    """One row: n and the mean of the clipped values with Laplace noise."""
    if budget is not None:
        budget.draw(epsilon, f"mean of {col}")
    x = F.greatest(F.lit(low), F.least(F.lit(high), number(col)))
    one = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"))
    return one.select("n", (F.col("m") + laplace((high - low) / F.col("n") / epsilon, seed, "mean", F.lit(col))).alias("private_mean"))


def anonymize(df: DataFrame, level: str, keys: list[str], ids: list[str], sensitive: list[str], salt: str, seed: int, row_key: list[str] | None = None) -> DataFrame:
    """minimal: identifiers hashed. balanced: k-anonymity too. high: l-diversity and noise of 1 % of the range on other numbers too.

    row_key: columns that tell rows apart (default: ids); the noise of a row is drawn from them, so level high needs some.
    """
    from ..functions.strings import salted_hash

    row_key = list(row_key or ids)
    if level == "high" and not row_key:
        raise ValueError("level high needs row_key: columns that tell rows apart")
    preset = PRESETS[level]
    out = df.withColumns({c: salted_hash(F.col(c), salt) for c in ids})
    if level != "minimal":
        out = k_anonymize(out, keys, preset["k"])
    if level == "high":
        out = l_diverse(out, keys, sensitive, preset["l"]) if sensitive else out
        for c in [c for c in numeric_columns(df) if c not in keys + ids + row_key]:
            span = out.agg((F.max(number(c)) - F.min(number(c))).alias("span_"))
            noise = laplace(F.lit(0.01) * F.col("span_") / preset["epsilon"], seed, f"noise-{c}", *[F.col(k) for k in row_key])
            out = out.crossJoin(F.broadcast(span)).withColumn(c, number(c) + noise).drop("span_")
    return out
