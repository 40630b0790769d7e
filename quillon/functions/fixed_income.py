"""Bond prices, yields, duration and convexity as column expressions, and curve interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flows(face: Column, coupon: Column, years: Column, per_year: int, weight) -> Column:
    """Sum of weight(k) * discounted flow over the periods; discounting is left to weight."""
    n = F.round(years * per_year).cast("int")
    pay = face * coupon / per_year
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, k: acc + weight(k) * (pay + F.when(k == n, face).otherwise(0.0)))


def price(face: Column, coupon: Column, years: Column, rate: Column, per_year: int = 2) -> Column:
    return _flows(face, coupon, years, per_year, lambda k: F.pow(1 + rate / per_year, -k))


def _present_value(face: np.ndarray, coupon: np.ndarray, n: np.ndarray, rate: np.ndarray, per_year: int) -> np.ndarray:
    """price of whole vectors, its flows as a geometric series; n: periods."""
    x = rate / per_year
    fall = -n * np.log1p(x)
    paid = np.where(x == 0, n, -np.expm1(fall) / np.where(x == 0, 1.0, x))
    return face * (coupon / per_year * paid + np.exp(fall))


def yield_to_maturity(clean_price: Column, face: Column, coupon: Column, years: Column, per_year: int = 2, steps: int = 80) -> Column:
    """By bisection between -90 % and 1000 % a year, a batch of bonds at once; null where an input isn't a finite number or no period is left."""

    @F.pandas_udf(T.DoubleType())
    def bisected(wanted: pd.Series, face: pd.Series, coupon: pd.Series, n: pd.Series) -> pd.Series:
        wanted, face, coupon, n = (x.to_numpy(float, na_value=np.nan) for x in (wanted, face, coupon, n))
        lo, hi = np.full(len(wanted), -0.9), np.full(len(wanted), 10.0)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(steps):
                mid = (lo + hi) / 2
                above = ~(_present_value(face, coupon, n, mid, per_year) <= wanted)  # an overflow is above, too
                lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
            known = np.isfinite(wanted + face + coupon + n) & (n >= 1)
        return pd.Series(np.where(known, (lo + hi) / 2, np.nan))

    return bisected(*[c.cast("double") for c in (clean_price, face, coupon, F.round(years * per_year))])


def macaulay_duration(face: Column, coupon: Column, years: Column, rate: Column, per_year: int = 2) -> Column:
    return _flows(face, coupon, years, per_year, lambda k: k / per_year * F.pow(1 + rate / per_year, -k)) / price(face, coupon, years, rate, per_year)


def convexity(face: Column, coupon: Column, years: Column, rate: Column, per_year: int = 2) -> Column:
    total = _flows(face, coupon, years, per_year, lambda k: k * (k + 1) * F.pow(1 + rate / per_year, -k - 2))
    return total / (per_year**2) / price(face, coupon, years, rate, per_year)


def interpolate_curve(tenor: Column, tenors: Sequence[float], rates: Sequence[float]) -> Column:
    """Linear between the points of a curve, flat beyond its ends."""
    points = sorted(zip(tenors, rates))
    out = F.lit(points[-1][1])
    for (a, ra), (b, rb) in reversed(list(zip(points, points[1:]))):
        out = F.when(tenor <= b, ra + (rb - ra) * (tenor - a) / (b - a)).otherwise(out)
    return F.when(tenor <= points[0][0], points[0][1]).otherwise(out)
