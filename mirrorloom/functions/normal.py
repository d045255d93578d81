"""The standard normal distribution: density, distribution function and its inverse, over Columns or numpy arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura's rational approximations of the inverse (algorithm AS 241, double precision), lowest power first.
# Numerator and denominator near the middle, in the tails, and far out in them.
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _polynomial(x, powers: tuple[float, ...]):
    out = powers[-1] * x + powers[-2]
    for p in powers[-3::-1]:
        out = out * x + p
    return out


def _ratio(x, table):
    return _polynomial(x, table[0]) / _polynomial(x, table[1])


def density(z: Column) -> Column:
    """The density; 0 for null, which stands for an infinite bound here."""
    return F.coalesce(F.exp(-z * z / 2) / math.sqrt(2 * math.pi), F.lit(0.0))


def quantile(p: Column) -> Column:
    """The inverse distribution function, to about 1e-15; null outside (0, 1) and for null."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(tail <= 5, _ratio(tail - 1.6, TAIL)).otherwise(_ratio(tail - 5, FAR))
    inner = q * _ratio(0.180625 - q * q, MIDDLE)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * outer))


def quantiles(p: np.ndarray) -> np.ndarray:
    """``quantile`` of an array; infinite at 0 and 1."""
    p = np.asarray(p, dtype="float64")
    q = p - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        outer = np.where(tail <= 5, _ratio(tail - 1.6, TAIL), _ratio(tail - 5, FAR))
        out = np.where(np.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, MIDDLE), np.sign(q) * outer)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


def share_below(x: Column) -> Column:
    """The distribution function, with an error below 1e-7 (a polynomial in 1 / (1 + p x))."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def quantile_sql(p: str) -> str:
    """``quantile`` as SQL, of an expression in (0, 1)."""

    def ratio(x: str, table) -> str:
        over, under = [f"list_sum([{', '.join(f'{c!r} * pow({x}, {i})' for i, c in enumerate(t))}])" for t in table]
        return f"({over} / {under})"

    q, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(f'(0.180625 - {q} * {q})', MIDDLE)} WHEN {tail} <= 5 THEN sign({q}) * {ratio(f'({tail} - 1.6)', TAIL)}
 ELSE sign({q}) * {ratio(f'({tail} - 5)', FAR)} END"""
