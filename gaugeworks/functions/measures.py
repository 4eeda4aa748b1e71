"""Rates and capability measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ppm(ng: Column, total: Column) -> Column:
    """Defects per million, rounded half to even; 0 without input."""
    return F.when(total > 0, F.bround(ng / total * 1e6, 0)).otherwise(F.lit(0.0))


def ppm_unrounded(ng: Column, total: Column) -> Column:
    return F.when(total > 0, ng / total * 1e6).otherwise(F.lit(0.0))


def improvement(normal: Column, test: Column) -> Column:
    """Percent by which test is below normal; null unless both are there and normal is positive."""
    return F.when((normal > 0) & test.isNotNull(), (normal - test) / normal * 100)


def out_of_limits(y: Column, low: Column, high: Column) -> Column:
    """Strictly outside, with both limits known."""
    return F.coalesce((y > high) | (y < low), F.lit(False)) & low.isNotNull() & high.isNotNull()


def later(actual: Column, planned: Column) -> Column:
    """Whether one time's text is after another's; false where either is blank."""
    return F.coalesce((F.trim(actual) != "") & (F.trim(planned) != "") & (actual > planned), F.lit(False))


def cpk(mean: Column, sigma: Column, low: Column, high: Column) -> Column:
    """Two-sided; null unless both limits are known and sigma is positive."""
    return F.when((sigma > 0) & low.isNotNull() & high.isNotNull(), F.least((high - mean) / (3 * sigma), (mean - low) / (3 * sigma)))


def cpk_any_side(mean: Column, sigma: Column, low: Column, high: Column) -> Column:
    """Of the limits that are known."""
    return F.when(sigma > 1e-12, F.least((high - mean) / (3 * sigma), (mean - low) / (3 * sigma)))


#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    total = F.lit(factors[0])
    for factor in factors[1:]:
        total = total * x + F.lit(factor)
    return total


def inverse_normal(p: Column) -> Column:
    """The z of a probability, clamped to 1e-7 from either end."""
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    tail = lambda q: _polynomial(q, TAIL_TOP) / _polynomial(q, TAIL_BOTTOM)
    q = p - 0.5
    centre = q * _polynomial(q * q, CENTRE_TOP) / _polynomial(q * q, CENTRE_BOTTOM)
    return F.when(p < TAIL, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - TAIL, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(centre)
