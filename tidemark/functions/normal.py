"""The normal distribution as columns: whole-stage code, no Python."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximations of the error function published by W. J. Cody (1969), highest power first.
# Below 0.46875 of erf(x) / x in x**2, up to 4 of exp(x**2) erfc(x) in x, above of the asymptotic form in 1 / x**2.
LOW_TOP = (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03)
LOW_BOTTOM = (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MIDDLE_TOP = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03)
MIDDLE_BOTTOM = (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
HIGH_TOP = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
HIGH_BOTTOM = (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _polynomial(c: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a * c + b, coefficients[1:], F.lit(coefficients[0]))


def erfc(x: Column) -> Column:
    """Complementary error function, to about 1e-15 of its size; null of null, NaN of NaN."""
    x = x.cast("double")
    a = F.abs(x)
    square = x * x
    low = 1 - x * _polynomial(square, LOW_TOP) / _polynomial(square, LOW_BOTTOM)
    middle = F.exp(-square) * _polynomial(a, MIDDLE_TOP) / _polynomial(a, MIDDLE_BOTTOM)
    inverse = 1 / F.when(a > 4, square).otherwise(16.0)
    high = F.exp(-square) / F.when(a > 4, a).otherwise(4.0) * (1 / math.sqrt(math.pi) - inverse * _polynomial(inverse, HIGH_TOP) / _polynomial(inverse, HIGH_BOTTOM))
    right = F.when(a <= 4, middle).when(a < 27, high).otherwise(F.lit(0.0))
    return F.when(x.isNull() | F.isnan(x), x).when(a <= 0.46875, low).when(x > 0, right).otherwise(2 - right)


def cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2))


def pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def two_sided(z: Column) -> Column:
    """Chance of a value at least as far from 0."""
    return erfc(F.abs(z) / math.sqrt(2))
