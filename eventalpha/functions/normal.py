"""Normal and t probabilities, which Spark SQL lacks, as vectorised helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def normal_cdf(z: Column | str) -> Column:
    def of(x: pd.Series) -> pd.Series:
        cdf = NormalDist().cdf
        return x.map(lambda v: None if v is None or math.isnan(v) else cdf(v))

    return pandas_udf(of, "double")(z)


def best_of(trials: float) -> float:
    """Expected greatest of so many standard normal draws (0 for one), by the usual two-quantile formula."""
    gamma, inv = 0.5772156649, NormalDist().inv_cdf
    return 0.0 if trials <= 1 else (1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * math.e))


def expected_best(trials: Column | str) -> Column:
    def of(n: pd.Series) -> pd.Series:
        return n.astype("float64").map(best_of)

    return pandas_udf(of, "double")(trials)


def t_two_sided(t: float, df: int) -> float:
    """P(|T| > |t|), by the continued fraction of the incomplete beta function."""
    if df <= 0:
        return 1.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            c = 1 + numerator / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h
