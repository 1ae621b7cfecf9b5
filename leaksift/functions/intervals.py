"""Closed-form intervals and tests as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published double-precision rational approximation of the
# normal tail by Hart, as given by West (2005), highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_FRACTION_TERMS = 24
# Fixed value: two-sided 95 % t quantile for ten paired runs (9 degrees of freedom).
T_CRITICAL_DF9 = 2.262


def z_quantile(alpha: float = 0.05) -> float:
    """Two-sided normal quantile for a confidence of ``1 - alpha``."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_tail(z: Column) -> Column:
    """P(Z > z), accurate in the far tail as well."""
    x = F.abs(z)
    density = F.exp(-(x * x) / 2)
    middle = density * _polynomial(x, TAIL_NUMERATOR) / _polynomial(x, TAIL_DENOMINATOR)
    fraction = x
    for step in range(TAIL_FRACTION_TERMS, 0, -1):
        fraction = x + F.lit(float(step)) / fraction
    far = density / fraction / math.sqrt(2 * math.pi)
    upper = F.when(x < TAIL_SWITCH, middle).otherwise(far)
    return F.when(z.isNull(), F.lit(None)).when(z < 0, 1 - upper).otherwise(upper)


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson score interval clamped to [0, 1]; (0, 0) when ``n`` is 0."""
    z = z_quantile(alpha)
    k, n = k.cast("double"), n.cast("double")
    safe = F.when(n > 0, n)
    p = k / safe
    scale = 1 + F.lit(z * z) / safe
    centre = (p + F.lit(z * z) / (2 * safe)) / scale
    half = F.lit(z) / scale * F.sqrt(p * (1 - p) / safe + F.lit(z * z) / (4 * safe * safe))
    low = F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0)
    high = F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(0.0)
    return low, high


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; infinite when the pooled error vanishes."""
    k1, n1, k2, n2 = (c.cast("double") for c in (k1, n1, k2, n2))
    pooled = (k1 + k2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when(error < 1e-12, F.lit(float("inf"))).otherwise((k1 / n1 - k2 / n2) / F.when(error >= 1e-12, error))


def two_sided_p(z: Column) -> Column:
    return F.when(F.abs(z) == float("inf"), 0.0).otherwise(2 * normal_tail(F.abs(z)))


def collision_probability(radius: int, bits: int) -> float:
    """Chance that two uniform fingerprints of ``bits`` bits lie within ``radius``."""
    return sum(math.comb(bits, d) for d in range(radius + 1)) / 2 ** bits
