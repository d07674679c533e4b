"""Array expressions (N03, N05-N10, N14, N15): Column in, Column out, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance."""
    return let(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def instance_zscore(w: Column) -> Column:
    """Z-score over all elements of a window; deviations below 1e-8 count as 1."""
    scale = lambda s: F.when(s < 1e-8, 1.0).otherwise(s)
    return let(mean(w), lambda m: let(scale(F.sqrt(variance(w))), lambda s: F.transform(w, lambda x: (x - m) / s)))


def revin(w: Column, channels: int = 1, eps: float = 1e-5) -> Column:
    """Each channel of a channel-major window by its own mean and sqrt(var + eps)."""
    n = (F.size(w) / channels).cast("int")
    part = lambda c: F.slice(w, c * n + 1, n)
    one = lambda a: let(mean(a), lambda m: let(F.sqrt(variance(a) + eps), lambda s: F.transform(a, lambda x: (x - m) / s)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: one(part(c))))


def l2_normalize(v: Column) -> Column:
    """Divide by the norm, which counts as 1e-12 at least."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))


def pool_tokens(tokens: Column, width: int) -> Column:
    """Unit tokens pooled to their means and deviations (1e-8 at least) by place."""
    units = F.transform(tokens, l2_normalize)
    at = lambda c: F.transform(units, lambda u: F.get(u, c))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return F.concat(F.transform(places, lambda c: mean(at(c))), F.transform(places, lambda c: F.greatest(F.sqrt(variance(at(c))), F.lit(1e-8))))


def entropy(a: Column) -> Column:
    """N08."""
    return -F.aggregate(a, F.lit(0.0), lambda s, x: s + x * F.ln(x + 1e-12))


def kl(p: Column, q: Column) -> Column:
    """Smoothed divergence of p from q."""
    return total(F.zip_with(p, q, lambda x, y: x * (F.ln(x + 1e-4) - F.ln(y + 1e-4))))


def normalized(p: Column) -> Column:
    """N10, first part: a row divided by its sum."""
    return let(total(p), lambda s: F.transform(p, lambda x: x / s))


def discrepancy(p: Column, q: Column) -> Column:
    """Divergence both ways, averaged, of the normalised rows."""
    return let(normalized(p), lambda a: let(normalized(q), lambda b: (kl(a, b) + kl(b, a)) / 2))


def mse(a: Column, b: Column) -> Column:
    """N15."""
    return squared_distance(a, b) / F.size(a)


def sanitize(x: Column, posinf: float = 1.7976931348623157e308, neginf: float = 0.0) -> Column:
    """NaN becomes 0, the infinities what is given; null stays null."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), posinf).when(x == float("-inf"), neginf).otherwise(x)
