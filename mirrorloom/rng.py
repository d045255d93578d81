"""Random numbers from a hash of (seed, purpose, row key): the same for any partitioning, and in any engine with SHA-256."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, purpose: str, *key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of SHA-256."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def normal(seed: int | str, purpose: str, *key: Column) -> Column:
    """A standard normal number (Box-Muller on two uniform ones)."""
    a, b = uniform(seed, f"{purpose}-a", *key), uniform(seed, f"{purpose}-b", *key)
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(F.lit(2.0 * math.pi) * b)


def laplace(scale: Column | float, seed: int | str, purpose: str, *key: Column) -> Column:
    """A Laplace number of the scale, by the inverse distribution function."""
    u = uniform(seed, purpose, *key) - 0.5
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    return -scale * F.signum(u) * F.log(F.greatest(1.0 - 2.0 * F.abs(u), F.lit(1e-12)))


def integer(low: int, high: int, seed: int | str, purpose: str, *key: Column) -> Column:
    """An integer from low to high, both included."""
    return (F.lit(low) + F.floor(uniform(seed, purpose, *key) * (high - low + 1))).cast("long")


def choice(values: list[str], seed: int | str, purpose: str, *key: Column) -> Column:
    """One of the values."""
    place = F.floor(uniform(seed, purpose, *key) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)
