"""Performance metrics of return series: one window for wealth, one aggregate for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import cumulative, normal_cdf


def wealth(df: DataFrame, ret: str = "ret", by: list[str] | None = None, order: str = "date", out: str = "nav") -> DataFrame:
    """Cumulative product of 1 + ret within a series; a missing return has no wealth of its own."""
    w = cumulative(Window.partitionBy(*(by or ["series_id"])).orderBy(order))
    return df.withColumn(out, F.when(F.col(ret).isNotNull(), F.product(1 + F.col(ret)).over(w)))


def drawdown(df: DataFrame, nav: str = "nav", by: list[str] | None = None, order: str = "date", out: str = "drawdown") -> DataFrame:
    """Loss from the highest wealth so far, the initial 1 included; positive."""
    w = cumulative(Window.partitionBy(*(by or ["series_id"])).orderBy(order))
    peak = F.greatest(F.lit(1.0), F.max(nav).over(w))
    return df.withColumn(out, F.greatest(F.lit(0.0), 1 - F.col(nav) / peak))


def sharpe(r: Column, rf: float = 0.0, periods: int = 12) -> Column:
    sd = F.stddev_samp(r - rf)
    return F.when(sd == 0, 0.0).otherwise(F.try_divide(F.avg(r - rf), sd) * periods**0.5)


def annual_return(r: Column, periods: int = 12) -> Column:
    """Geometric; missing returns count as periods."""
    n = F.count(F.lit(1))
    return F.when(n == 0, 0.0).otherwise(F.pow(F.coalesce(F.product(1 + r), F.lit(1.0)), F.try_divide(F.lit(float(periods)), n)) - 1)


def annual_volatility(r: Column, periods: int = 12) -> Column:
    return F.stddev_samp(r) * periods**0.5


def win_rate(r: Column) -> Column:
    return F.try_divide(F.sum(F.when(r > 0, 1.0).otherwise(0.0)), F.count(F.lit(1)))


def arithmetic_annual_return(r: Column, periods: int = 12) -> Column:
    return F.avg(r) * periods


def downside_deviation(r: Column, target: float = 0.0) -> Column:
    return F.sqrt(F.avg(F.pow(F.when(r.isNotNull(), F.least(r - target, F.lit(0.0))), F.lit(2))))


def sortino(r: Column, rf: float = 0.0, periods: int = 12, target: float | None = None) -> Column:
    dd = downside_deviation(r, rf if target is None else target)
    return F.when(dd > 0, F.try_divide((F.avg(r) - rf) * periods, dd * periods**0.5)).otherwise(0.0)


def modigliani(r: Column, benchmark: Column, rf: float = 0.0, periods: int = 12) -> Column:
    return sharpe(r, rf, periods) * F.stddev_samp(benchmark) * periods**0.5 + rf * periods


def historical_var(r: Column, level: float = 0.05) -> Column:
    return -F.percentile(r, F.lit(level))


def psr_z(r: Column, rf: float = 0.0, target: float = 0.0) -> Column:
    """The statistic of the probabilistic Sharpe ratio, from bias-corrected skewness and kurtosis; null if degenerate."""
    n = F.count(r).cast("double")
    sr = F.when(F.stddev_samp(r) > 0, F.try_divide(F.avg(r) - rf, F.stddev_samp(r)))
    varies = F.var_pop(r) > 0
    g1, g2 = F.when(varies, F.skewness(r)), F.when(varies, F.kurtosis(r))  # from central moments
    skew = g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    kurt = F.when(n > 3, F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3)) + 3).when(n == 3, g2 + 3)
    inside = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when((n > 2) & (inside > 0), (sr - target) * F.sqrt(n - 1) / F.sqrt(inside))


def psr(z: Column) -> Column:
    """Probability that the true Sharpe ratio exceeds the target; 0.5 where it can't be told."""
    return F.coalesce(normal_cdf(z), F.lit(0.5))


def performance_summary(df: DataFrame, by: list[str], ret: str = "ret", order: str = "date", periods: int = 12) -> DataFrame:
    """One row for each series."""
    r = F.col(ret)
    rows = drawdown(wealth(df, ret, by, order), by=by, order=order)
    out = rows.groupBy(*by).agg(
        annual_return(r, periods).alias("annual_return"),
        annual_volatility(r, periods).alias("annual_volatility"),
        sharpe(r, 0.0, periods).alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"),
        win_rate(r).alias("win_rate"),
        (F.coalesce(F.product(1 + r), F.lit(1.0)) - 1).alias("total_return"),
        F.count(F.lit(1)).alias("n"),
    )
    calmar = F.when(F.col("max_drawdown") > 0, F.try_divide(F.col("annual_return"), F.col("max_drawdown"))).otherwise(0.0)
    return out.withColumn("calmar", calmar)
