"""Look-alike tables: marginals, bootstrap, perturbation, masks, copula, repair of relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numeric, strings
from ..rng import choice, integer, normal, uniform
from .profile import number, numeric_columns, value_counts


def _slots(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "row_id")


def marginals(df: DataFrame, n: int, seed: int, numeric_cols: list[str], categorical: list[str], most: int = 100_000) -> DataFrame:
    """row_id and n independent rows: numbers normal with the column's mean and deviation, categories by their shares.

    A category is drawn by a uniform number in the cumulative shares of one array for each column;
    a column of more than ``most`` values is met by an equi-join on its sorted position instead. Both draw the same values.
    """
    stats = df.agg(*[F.coalesce(f(number(c)), F.lit(0.0)).alias(f"{c}:{k}") for c in numeric_cols for k, f in (("m", F.avg), ("s", F.stddev_samp))] or [F.count("*").alias(":n")])
    out = _slots(df.sparkSession, n).crossJoin(F.broadcast(stats))
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    for c in numeric_cols:
        x = F.col(f"`{c}:m`") + F.col(f"`{c}:s`") * normal(seed, f"marginal-{c}", F.col("row_id"))
        out = out.withColumn(c, F.round(x).cast("long") if c in whole else x)
    out = out.drop(*stats.columns)
    for c in categorical:
        counts = value_counts(df, [c]).select("value", "n", "total")
        out = draw_category(out, counts, c, uniform(seed, f"marginal-{c}", F.col("row_id")), most)
    return out


def draw_category(out: DataFrame, counts: DataFrame, c: str, u: Column, most: int = 100_000) -> DataFrame:
    """out with c, the value (null may be one) at u, a number in [0, 1), of the cumulative shares of counts: value, n, total."""
    if counts.count() > most:
        return _draw_by_position(out, counts, c, u)
    order = Window.orderBy("value")  # at most so many values
    cdf = counts.withColumn("cdf", F.sum("n").over(order) / F.col("total")).agg(F.sort_array(F.collect_list(F.struct("cdf", "value"))).alias("a_"))
    place = F.least(F.size(F.filter("a_", lambda e: e["cdf"] <= F.col("u_"))), F.size("a_") - 1)
    return out.withColumn("u_", u).crossJoin(F.broadcast(cdf)).withColumn(c, F.get("a_", place)["value"]).drop("a_", "u_")


def _draw_by_position(out: DataFrame, counts: DataFrame, c: str, u: Column) -> DataFrame:
    """A category by the position of a uniform number among all rows: positions are dealt to buckets that both sides join on."""
    from .relate import running

    total = counts.agg(F.max("total")).first()[0]
    width = max(1, total // 1_000_000)
    spans = running(counts, "value", ["n"]).select(F.col("value").alias("value_"), F.col("before_n").alias("before_"), (F.col("before_n") + F.col("n")).alias("end_"))
    spans = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("before_") / width), F.floor((F.col("end_") - 1) / width))))
    at = F.least(F.floor(u * total), F.lit(total - 1))
    drawn = out.withColumn("at_", at).withColumn("bucket_", F.floor(F.col("at_") / width))
    return drawn.join(spans, "bucket_").filter((F.col("at_") >= F.col("before_")) & (F.col("at_") < F.col("end_"))).withColumn(c, F.col("value_")).select(*out.columns, c)


def numbered(df: DataFrame, key: list[str], to: str = "pos_") -> DataFrame:
    """df with a dense position from 0 in the order of key: counts of ranges first, then positions inside each."""
    buckets = max(256, df.count() // 250_000)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets))
    sized = df.withColumn("b_", bucket)
    starts = sized.groupBy("b_").agg(F.count("*").alias("c_")).withColumn("start_", F.coalesce(F.sum("c_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a bucket
    inside = F.row_number().over(Window.partitionBy("b_").orderBy(*key)) - 1
    return sized.withColumn("i_", inside).join(F.broadcast(starts.drop("c_")), "b_").withColumn(to, (F.col("start_") + F.col("i_")).cast("long")).drop("b_", "i_", "start_")


def bootstrap(df: DataFrame, key: list[str], n: int, seed: int, noise: float = 0.0, noisy: list[str] | None = None) -> DataFrame:
    """row_id and n rows drawn with replacement; noise: a share of the deviation added to the noisy columns."""
    rows = numbered(df, key)
    total = df.count()
    drawn = _slots(df.sparkSession, n).withColumn("pos_", F.floor(uniform(seed, "bootstrap", F.col("row_id")) * total).cast("long"))
    out = drawn.join(rows, "pos_").drop("pos_")
    for c in noisy or []:
        s = df.agg(F.stddev_samp(number(c)).alias("s_"))
        out = out.crossJoin(F.broadcast(s)).withColumn(c, number(c) + noise * F.col("s_") * normal(seed, f"noise-{c}", F.col("row_id"))).drop("s_")
    return out


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement: the first in the order of a hash."""
    return df.withColumn("u_", uniform(seed, "sample", *map(F.col, key))).orderBy("u_", *key).limit(n).drop("u_")


def split(df: DataFrame, share: float, seed: int, *key: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key."""
    u = uniform(seed, "split", *map(F.col, key))
    return df.filter(u < share), df.filter(u >= share)


def nearest_to(df: DataFrame, col: str, value: float, n: int, *key: str) -> DataFrame:
    """The n rows whose value is nearest."""
    return df.orderBy(F.abs(number(col) - value), *key).limit(n)


def perturb(df: DataFrame, key: list[str], seed: int, factor: float = 0.2, numbers: list[str] = (), ages: list[str] = (), days: list[str] = (), categories: list[str] = (), span: int = 7) -> DataFrame:
    """Noise on numbers (factor of the deviation), ages (five years, 0 to 110), dates (span days); a share of categories swapped for others."""
    k = [F.col(c) for c in key]
    numbers, ages, days, categories = map(list, (numbers, ages, days, categories))
    held = {c: value_list(df, c) for c in categories}
    stats = df.agg(*[F.stddev_samp(number(c)).alias(f"{c}:s") for c in numbers] or [F.count("*").alias(":n")])
    for c, values in held.items():
        stats = stats.crossJoin(F.broadcast(values.withColumnRenamed("v_", f"{c}:v"))) if values is not None else stats
    j = df.crossJoin(F.broadcast(stats))
    out: dict[str, Column] = {c: number(c) + factor * F.col(f"`{c}:s`") * normal(seed, f"perturb-{c}", *k) for c in numbers}
    out |= {c: F.greatest(F.lit(0), F.least(F.lit(110), F.col(c) + integer(-5, 5, seed, f"perturb-{c}", *k))) for c in ages}
    out |= {c: dates.jitter(F.col(c), span, seed, *k) for c in days}

    def others_of(c: str) -> Column:
        return F.filter(F.col(f"`{c}:v`"), lambda v: v != F.col(c))

    for c in [c for c in categories if held[c] is not None]:
        others = others_of(c)
        pick = F.get(others, F.floor(uniform(seed, f"pick-{c}", *k) * F.size(others)).cast("int"))
        out[c] = F.when((uniform(seed, f"swap-{c}", *k) < factor) & (F.size(others) > 0), pick).otherwise(F.col(c))
    j = j.withColumns(out).drop(*stats.columns)
    for c in [c for c in categories if held[c] is None]:
        swaps = uniform(seed, f"swap-{c}", *k) < factor
        j = drawn_value(j, df, c, swaps, uniform(seed, f"pick-{c}", *k), other=True)
    return j.select(*df.columns)


#: Distinct values of a column up to so many, and so many characters, are held in one row that is broadcast.
HELD_VALUES, HELD_CHARACTERS = 10_000, 4_000_000


def value_list(df: DataFrame, c: str, most: int | None = None) -> DataFrame | None:
    """One row with the sorted distinct values in v_; None where they are too many or too long for one row, which is counted first."""
    values = df.select(F.col(f"`{c}`").alias("v_")).dropna().distinct()
    n, size = values.agg(F.count("*"), F.coalesce(F.sum(F.length(F.col("v_").cast("string"))), F.lit(0))).first()
    if n > (HELD_VALUES if most is None else most) or size > HELD_CHARACTERS:
        return None
    return values.agg(F.sort_array(F.collect_list("v_")).alias("v_"))


def drawn_value(df: DataFrame, source: DataFrame, c: str, where: Column, u: Column, other: bool) -> DataFrame:
    """df with c, where the condition holds, as one of source's distinct values by a uniform number u; ``other``: but its own.

    The values are numbered in their order by running sums and meet the rows by equi-joins, so their number doesn't matter.
    The value drawn is the one that the sorted list of ``value_list`` would give.
    """
    from .relate import running

    values = running(source.select(F.col(f"`{c}`").alias("v_")).dropna().distinct().withColumn("one_", F.lit(1).cast("long")), "v_", ["one_"]).select("v_", F.col("before_one_").alias("at_"))
    n = source.select(F.count_distinct(F.col(f"`{c}`")).alias("n_"))
    rows = df.crossJoin(F.broadcast(n)).withColumns({"w_": F.coalesce(where, F.lit(False)), "u_": u})
    if other:
        rows = rows.join(values.select(F.col("v_").alias("own_"), F.col("at_").alias("own_at_")), F.col(f"`{c}`") == F.col("own_"), "left").drop("own_")
        j = F.floor(F.col("u_") * (F.col("n_") - 1))
        place = F.when(F.col("n_") > 1, F.when(F.col("own_at_").isNull() | (j < F.col("own_at_")), j).otherwise(j + 1))
    else:
        place = F.floor(F.col("u_") * F.col("n_"))
    rows = rows.withColumn("place_", F.when(F.col("w_"), place)).join(values.select(F.col("v_").alias("new_"), F.col("at_").alias("place_")), "place_", "left")
    return rows.withColumn(c, F.coalesce("new_", F.col(f"`{c}`"))).select(*[F.col(f"`{x}`") for x in df.columns])


def shuffle_values(df: DataFrame, key: list[str], col: str, share: float, seed: int) -> DataFrame:
    """The values of col shuffled among a random share of rows: positions by key meet positions by a random number."""
    k = [F.col(c) for c in key]
    masked = df.withColumn("m_", uniform(seed, f"mask-{col}", *k) < share)
    inside = masked.filter("m_").select(*key, F.col(col).alias("v_"), uniform(seed, f"order-{col}", *k).alias("o_"))
    by_key, by_chance = numbered(inside.select(*key), key), numbered(inside.select("v_", "o_"), ["o_"])
    new = by_key.join(by_chance, "pos_").select(*key, F.col("v_").alias("new_"))
    return masked.join(new, key, "left").withColumn(col, F.when(F.col("m_"), F.col("new_")).otherwise(F.col(col))).select(*df.columns)


#: The masks of a column by name: (column, seed, key) -> Column.
MASKS = {
    "random_numeric": lambda c, s, *k: integer(0, 1_000_000, s, "random", *k),
    "scaled_numeric": lambda c, s, *k: c * (0.8 + 0.4 * uniform(s, "scale", *k)),
    "random_names": lambda c, s, *k: strings.random_name(s, *k),
    "initials_only": lambda c, s, *k: strings.initials(c),
    "random_emails": lambda c, s, *k: F.concat(F.lit("user"), integer(1000, 9999, s, "email", *k).cast("string"), F.lit("@example.com")),
    "domain_preserve": lambda c, s, *k: strings.email_domain_preserved(c, s, *k),
    "random_addresses": lambda c, s, *k: strings.random_address(s, *k),
    "city_only": lambda c, s, *k: choice(strings.CITIES, s, "city", *k),
    "random_phones": lambda c, s, *k: strings.random_phone(s, *k),
    "format_preserve": lambda c, s, *k: strings.format_preserved(c.cast("string"), s, *k),
    "random_dates": lambda c, s, *k: dates.random_date(s, *k),
    "month_year_only": lambda c, s, *k: dates.month_year(c),
    "random_text": lambda c, s, *k: F.concat(F.lit("Text_"), integer(1000, 9999, s, "text", *k).cast("string")),
}


def mask(df: DataFrame, methods: dict[str, str], key: list[str], seed: int) -> DataFrame:
    """Columns masked by method; random_in_range and random_categorical take their range or values from the column."""
    k = [F.col(c) for c in key]
    out = df
    for c, method in methods.items():
        if method == "random_in_range":
            edge = df.agg(F.min(number(c)).alias("a_"), F.max(number(c)).alias("b_"))
            out = out.crossJoin(F.broadcast(edge)).withColumn(c, F.col("a_") + (F.col("b_") - F.col("a_")) * uniform(seed, f"range-{c}", *k)).drop("a_", "b_")
        elif method == "random_categorical":
            values = value_list(df, c)
            if values is None:
                out = drawn_value(out, df, c, F.lit(True), uniform(seed, f"category-{c}", *k), other=False)
                continue
            out = out.crossJoin(F.broadcast(values)).withColumn(c, F.get("v_", F.floor(uniform(seed, f"category-{c}", *k) * F.size("v_")).cast("int"))).drop("v_")
        elif method in MASKS:
            out = out.withColumn(c, MASKS[method](F.col(c), seed, *k))
        else:
            raise ValueError(f"unknown method {method}")
    return out


def copula(df: DataFrame, n: int, seed: int, cols: list[str], points: int = 1001) -> DataFrame:
    """row_id and n rows from a Gaussian copula of numbers, times and categories (see the module ``copula``)."""
    from . import copula as mixed

    return mixed.sample(mixed.fit(df, cols, points), n, seed)


def repair_order(df: DataFrame, start: str, end: str, low: float, high: float, seed: int, *key: str) -> DataFrame:
    """Rows whose end lies before the start get an end after it, by a duration drawn from low to high days."""
    seconds = ((low + (high - low) * uniform(seed, "repair", *map(F.col, key))) * 86_400).cast("long")
    moved = F.timestamp_seconds(F.unix_timestamp(F.col(start).cast("timestamp")) + seconds).cast("timestamp_ntz")
    return df.withColumn(end, F.when(F.col(end) < F.col(start), moved).otherwise(F.col(end)))


def repair_durations(df: DataFrame, start: str, end: str, marks: tuple[float, float, float, float, float], seed: int, *key: str, every: bool = False) -> DataFrame:
    """Rows whose end lies before the start (``every``: all rows) get an end after it, by a duration in days drawn like those seen.

    marks: minimum, quartiles and maximum of the durations; each of the four parts between them is drawn as often, evenly inside.
    """
    k = [F.col(c) for c in key]
    part = F.floor(4 * uniform(seed, "segment", *k)).cast("int")
    edges = F.array(*[F.lit(float(m)) for m in marks])
    days = F.get(edges, part) + (F.get(edges, part + 1) - F.get(edges, part)) * uniform(seed, "within", *k)
    moved = F.timestamp_seconds(F.unix_timestamp(F.col(start).cast("timestamp")) + (days * 86_400).cast("long")).cast("timestamp_ntz")
    wrong = F.lit(True) if every else F.col(end) < F.col(start)
    return df.withColumn(end, F.when(wrong, moved).otherwise(F.col(end)))


def copy_columns(made: DataFrame, own: DataFrame, key: list[str], cols: list[str], seed: int) -> DataFrame:
    """made with cols copied from own: by key where made has it; else each row takes all of them from one row, drawn by its row_id."""
    if not cols:
        return made
    kept = made.drop(*cols)
    if all(c in made.columns for c in key):
        return kept.join(own.select(*key, *[c for c in cols if c not in key]), key, "left")
    rows = numbered(own.select(*dict.fromkeys([*key, *cols])), key)
    total = own.count()
    drawn = kept.withColumn("pos_", F.floor(uniform(seed, "copy", F.col("row_id")) * total).cast("long"))
    return drawn.join(rows.select("pos_", *cols), "pos_", "left").drop("pos_")


def copy_private(df: DataFrame, methods: dict[str, str], key: list[str], seed: int, hashed: list[str] = (), salt: str = "") -> DataFrame:
    """A copy of df with columns masked by method, and others hashed with a salt."""
    out = mask(df, methods, key, seed)
    return out.withColumns({c: strings.salted_hash(F.col(f"`{c}`").cast("string"), salt) for c in hashed}) if hashed else out


def quality_fixes(df: DataFrame, ages: list[str] = (), decimals: dict[str, int] | None = None) -> DataFrame:
    """Ages whole and from 0 to 120, infinities as nulls, numbers rounded half to even."""
    out = {c: F.greatest(F.lit(0), F.least(F.lit(120), F.bround(number(c), 0))).cast("long") for c in ages}
    finite = lambda c: F.when(F.abs(number(c)) != float("inf"), number(c))
    out |= {c: F.bround(finite(c), d) for c, d in (decimals or {}).items()}
    return df.withColumns(out)


GENERATORS = ("marginals", "bootstrap", "perturb", "copula")


def generate(df: DataFrame, method: str, key: list[str], n: int | None = None, seed: int = 42, factor: float = 0.2) -> DataFrame:
    """A look-alike of df by one of GENERATORS; an unknown method is an error."""
    numbers = [c for c in numeric_columns(df) if c not in key]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in key]
    n = df.count() if n is None else n
    if method == "marginals":
        return marginals(df, n, seed, numbers, texts)
    if method == "bootstrap":
        return bootstrap(df, key, n, seed, 0.1, numbers)
    if method == "perturb":
        return perturb(df, key, seed, factor, numbers=numbers, categories=texts)
    if method == "copula":
        times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) and f.name not in key]
        return copula(df, n, seed, [c for c in df.columns if c in numbers + texts + times])
    raise ValueError(f"unknown method {method}; known: {', '.join(GENERATORS)}")


def age_groups(df: DataFrame, col: str, method: str = "equal_width", **options) -> DataFrame:
    """col as bands: equal_width or life_stages."""
    band = {"equal_width": numeric.age_band, "life_stages": numeric.life_stage}[method]
    return df.withColumn(col, band(number(col), **options))


def conditional_sample(df: DataFrame, equal: dict[str, str], near: dict[str, float], n: int, *key: str) -> DataFrame:
    """The n rows that have the categories and lie nearest to the numbers, in standard deviations."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    if not near:
        return df.orderBy(*key).limit(n)
    stats = df.agg(*[F.stddev_pop(number(c)).alias(f"{c}:s") for c in near])
    far = sum((F.abs(number(c) - v) / F.when(F.col(f"`{c}:s`") > 0, F.col(f"`{c}:s`")).otherwise(1.0) for c, v in near.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn("far_", far).orderBy("far_", *key).limit(n).select(*df.columns)
