"""Tails of the normal, chi-squared and t distributions as Column expressions."""

from __future__ import annotations

from functools import cache
from math import atan, cos, lgamma, pi, sin, sqrt, tan
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of erf with an error below 1.5e-7.
_P, _A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + _P * x)
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def chi2_sf(x: Column, dof: int) -> Column:
    """Upper tail of chi-squared with a known number of degrees of freedom, by its finite series."""
    h = x / 2
    if dof % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, dof // 2):
            term = term * h / k
            total = total + term
        return F.exp(-h) * total
    total = 2 * normal_sf(F.sqrt(x))
    for k in range(1, dof // 2 + 1):
        total = total + F.exp(-h) * F.pow(h, k - 0.5) / F.exp(F.lit(lgamma(k + 0.5)))
    return total


#: Degrees of freedom up to which quantiles of t are exact.
EXACT_DOF = 200


def t_within(t: float, dof: int) -> float:
    """Probability that |T| is at most t, by the finite series in the angle atan(t / sqrt(dof))."""
    angle = atan(t / sqrt(dof))
    c2, odd = cos(angle) ** 2, dof % 2
    term = total = (cos(angle) if odd else 1.0) if dof > 1 else 0.0
    for k in range(2 + odd, dof - 1, 2):
        term *= (k - 1) / k * c2
        total += term
    return 2 / pi * (angle + sin(angle) * total) if odd else sin(angle) * total


@cache
def _exact(dof: int, p: float) -> float:
    low, high = 0.0, pi / 2  # of the angle
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_within(tan(mid) * sqrt(dof), dof) < 2 * p - 1 else (low, mid)
    return tan(high) * sqrt(dof)


def t_quantile(dof: Column, p: float = 0.975) -> Column:
    """Quantile of Student's t: exact up to EXACT_DOF whole degrees of freedom, then by the expansion in 1 / dof; NULL below one."""
    z = NormalDist().inv_cdf(p)
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    table = F.array(*[F.lit(_exact(v, p)) for v in range(1, EXACT_DOF + 1)])
    exact = F.element_at(table, F.least(F.greatest(dof, F.lit(1)), F.lit(EXACT_DOF)).cast("int"))
    return F.when(dof > EXACT_DOF, z + g[0] / dof + g[1] / (dof * dof) + g[2] / (dof * dof * dof)).when(dof >= 1, exact)
