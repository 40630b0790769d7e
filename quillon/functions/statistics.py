"""Column expressions for statistics that stay defined where Spark's own raise or give NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities as missing."""
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def average_rank(value: Column, over: list[str]) -> Column:
    """Ranks from 1, ties share their mean rank."""
    by = [F.col(c) for c in over]
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def safe_corr(x: Column, y: Column, least: int = 5) -> Column:
    """Pearson correlation of complete pairs; null for fewer than `least` pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(a) >= least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), value)


def cumulative(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by the error function's series in the JVM.

    erf(x) = 2/sqrt(pi) exp(-x^2) sum_n 2^n x^(2n+1) / (2n+1)!!; beyond |z| = 8 it is 0 or 1 to double precision.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step, lambda acc: acc["sum"])
    erf = F.lit(1.1283791670955126) * F.exp(-x * x) * total
    half = F.when(F.abs(z) > 8, 1.0).otherwise(erf)
    return F.when(z >= 0, (1 + half) / 2).otherwise((1 - half) / 2)


SERIES_TO = 400  # degrees of freedom up to which the finite series is summed


def student_t_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| > |t|) for whole degrees of freedom.

    With u = atan(|t| / sqrt(v)) the probability between -t and t is a finite series in cos(u), of v / 2 terms.
    From SERIES_TO on, t is first turned into a normal deviate by Hill's expansion (1970), which is good to 1e-12 there.
    """
    u = F.atan(F.abs(t) / F.sqrt(freedom))
    odd = F.pmod(freedom.cast("int"), F.lit(2)) == 1
    c2 = F.cos(u) * F.cos(u)
    first = F.when(odd, F.cos(u)).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        """Term k is (2k-2)/(2k-1) cos^2 times the one before for odd v, (2k-3)/(2k-2) cos^2 for even v."""
        ratio = F.when(odd, (2.0 * k - 2) / (2 * k - 1)).otherwise((2.0 * k - 3) / (2 * k - 2))
        term = F.when(k == 1, s["term"]).otherwise(s["term"] * ratio * c2)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = F.floor(F.when(odd, freedom - 1).otherwise(freedom) / 2).cast("int")
    total = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda s: s["sum"])).otherwise(0.0)
    inside = F.when(odd, (u + F.sin(u) * total) * (2 / 3.141592653589793)).otherwise(F.sin(u) * total)
    a = freedom - 0.5
    b, z2 = 48 * a * a, a * F.log1p(t * t / freedom)
    z = F.sqrt(z2)
    deviate = z + (z2 + 3) * z / b - (4 * z2 * z2 * z2 + 33 * z2 * z2 + 240 * z2 + 855) * z / (10 * b * (b + 0.8 * z2 * z2 + 100))
    value = F.when(freedom <= SERIES_TO, 1 - inside).otherwise(2 * normal_cdf(-deviate))
    return F.when(t.isNotNull() & (freedom >= 1), F.greatest(F.lit(0.0), value))
