"""Timing strategies: positions from lagged signals, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import cumulative


def signal_backtest(df: DataFrame, cost_bps: float = 0.0, lag: int = 1, by: str = "series_id") -> DataFrame:
    """df: by, date, ret, signal on the return's dates. Adds position, turnover, net, nav, bench_nav.

    The position is the signal of lag dates earlier, 0 before there is one.
    """
    if lag < 1:
        raise ValueError("a signal can't be traded on its own date: lag must be 1 or more")
    own = Window.partitionBy(by).orderBy("date")
    rows = df.withColumn("position", F.coalesce(F.lag("signal", lag).over(own), F.lit(0.0)))
    rows = rows.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(own), F.lit(0.0))))
    rows = rows.withColumn("net", F.coalesce(F.col("position") * F.col("ret"), F.lit(0.0)) - F.col("turnover") * cost_bps / 1e4)
    upto = cumulative(own)
    return rows.withColumn("nav", F.product(1 + F.col("net")).over(upto)).withColumn("bench_nav", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(upto))


def reconstruct_returns(df: DataFrame, nav: str = "nav", by: str = "series_id", out: str = "r") -> DataFrame:
    """Returns from wealth; the first is wealth less 1."""
    return df.withColumn(out, F.col(nav) / F.coalesce(F.lag(nav).over(Window.partitionBy(by).orderBy("date")), F.lit(1.0)) - 1)


def timing_metrics(df: DataFrame, periods: int = 252, by: str = "series_id") -> DataFrame:
    """From nav, bench_nav, position: one row for each series. The Sharpe ratio is geometric return by volatility."""
    own = Window.partitionBy(by).orderBy("date")
    rows = reconstruct_returns(reconstruct_returns(df, "nav", by, "r"), "bench_nav", by, "b")
    rows = rows.withColumn("dd", 1 - F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(cumulative(own))))
    rows = rows.withColumn("bdd", 1 - F.col("bench_nav") / F.greatest(F.lit(1.0), F.max("bench_nav").over(cumulative(own))))
    rows = rows.withColumn("trade", F.col("position") != F.coalesce(F.lag("position").over(own), F.lit(0.0)))
    held = F.col("position") != 0
    gain, loss = F.sum(F.when(held & (F.col("r") > 0), F.col("r"))), F.sum(F.when(held & (F.col("r") < 0), -F.col("r")))
    n = F.count(F.lit(1))
    out = rows.groupBy(by).agg(
        (F.pow(F.max_by("nav", "date"), periods / n) - 1).alias("annual_return"),
        (F.stddev_samp("r") * periods**0.5).alias("annual_volatility"),
        F.max("dd").alias("max_drawdown"),
        (F.pow(F.max_by("bench_nav", "date"), periods / n) - 1).alias("bench_annual_return"),
        F.max("bdd").alias("bench_max_drawdown"),
        F.coalesce(F.avg(F.when(held, (F.col("r") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide(gain, loss), F.lit(0.0)).alias("profit_loss_ratio"),
        F.sum(F.col("trade").cast("long")).alias("trade_count"),
        F.avg(held.cast("double")).alias("holding_share"),
        n.alias("n"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.try_divide(F.col(a), F.col(b))).otherwise(0.0)
    return out.withColumn("sharpe", ratio("annual_return", "annual_volatility")).withColumn("calmar", ratio("annual_return", "max_drawdown")).withColumn("excess_return", F.col("annual_return") - F.col("bench_annual_return"))
