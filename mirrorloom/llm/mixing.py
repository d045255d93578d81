"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: One draw inverts a Poisson distribution of this mean at most; a larger mean is the sum of several draws.
MEAN_PER_DRAW = 8.0
#: Terms of the inverted distribution: a mean of MEAN_PER_DRAW passes them with a chance below 1e-16.
TERMS = 48


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the hash of seed and keys: 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(seed), *keys)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, total: float | None) -> DataFrame:
    """source, n, rate: the mean number of copies of each document of a source.

    The weights hold for the sources named (those not named get none); without weights every
    source has the same. A null source is a source of its own, named by the key None. Sources
    without documents have no rows, so the weights of the others are scaled up to fill them.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "given string, weight double")
        counts = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = materialize(counts, "sources")
    sums = counts.agg(F.sum("n"), F.sum("weight")).first()
    goal, weight = float(total if total is not None else sums[0] or 0), float(sums[1] or 0)
    return counts.withColumn("rate", F.col("weight") * F.lit(goal) / F.lit(weight or 1.0) / F.col("n"))


def poisson_table(rate: Column) -> tuple[Column, Column]:
    """The number of draws for a rate, and the distribution function of one draw as an array."""
    draws = F.greatest(F.lit(1), F.ceil(rate / MEAN_PER_DRAW)).cast("int")
    mean = rate / draws
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"))
    return draws, F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["cdf"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", source_col: str = "source", id_col: str = "doc_id", total: float | None = None) -> DataFrame:
    """Each document as often as a Poisson draw says, all copies in a global random order.

    The draw's mean is the repetition rate that brings its source to its share of ``total``
    documents (default: as many as there are); the draw inverts the distribution at a number
    hashed from seed, identifier and draw. New columns: copy (from 1) and mix_key, by which
    the copies are dealt out and sorted; a column of docs of that name is renamed source_<name>.

    Rows that repeat an identifier draw alike. Null identifiers hash as the word null. Null or
    empty texts are documents like any other. A source of weight 0 gives no row, an empty table
    an empty result. A source may hold any share of the rows: the rates are counted with partial
    sums and joined as one row per source; the shuffle deals out by a hash of the copy.
    """
    taken = {c.lower() for c in docs.columns}
    base = docs.select(*[F.col(f"`{c}`").alias(f"source_{c}" if c.lower() in ("copy", "mix_key") else c) for c in docs.columns]) if taken & {"copy", "mix_key"} else docs
    draws_col, cdf_col, key, source = fresh(base, "mix_draws", "mix_cdf", "mix_id", "mix_source")
    rates = source_rates(docs, weights, source_col, total)
    draws, cdf = poisson_table(F.col("rate"))
    rates = materialize(rates.select(F.col("source").alias(source), draws.alias(draws_col), cdf.alias(cdf_col)), "rates")
    joined = base.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    joined = joined.withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    one = lambda i: F.size(F.filter(F.col(cdf_col), lambda c: c <= uniform(seed, F.col(key), i.cast("string"))))
    count = F.when(F.col(draws_col) == 1, one(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col(draws_col)), F.lit(0), lambda acc, i: acc + one(i)))
    copies = joined.withColumn(draws_col, count).filter(F.col(draws_col) > 0)
    copies = copies.select(*[F.col(f"`{c}`") for c in base.columns], F.col(key), F.explode(F.sequence(F.lit(1), F.col(draws_col))).alias("copy"))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(key), F.col("copy").cast("string")))).drop(key)
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")
