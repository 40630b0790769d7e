"""Factor backtests: quantile groups, their returns, turnover, cost and wealth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import performance_summary, wealth
from . import cross_section as xs


def group_steps(groups: DataFrame, by: str = "date", stock: str = "stock_code", group: str = "group", ret: str | None = None) -> DataFrame:
    """g, d, before, n, total, valid: members of each group and date by the date on which they were in the group before.

    One window by (group, stock) and one aggregate; a row for each group and pair of dates, whatever the number of stocks.
    """
    member = groups.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(by).alias("d"), F.col(stock).alias("s"), (F.col(ret) if ret else F.lit(None)).cast("double").alias("r"))
    member = member.withColumn("before", F.lag("d").over(Window.partitionBy("g", "s").orderBy("d")))
    return member.groupBy("g", "d", "before").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total"), F.count("r").alias("valid"))


def _dated(steps: DataFrame) -> DataFrame:
    """g, d, gross, turnover from group_steps."""
    dates = steps.groupBy("g", "d").agg(F.sum("n").alias("size"), F.try_divide(F.sum("total"), F.sum("valid")).alias("gross"))
    own = Window.partitionBy("g").orderBy("d")
    dates = dates.withColumns({"last": F.lag("d").over(own), "size_before": F.lag("size").over(own)})
    stayed = steps.where("before IS NOT NULL").select("g", "d", F.col("before").alias("last"), F.col("n").alias("common"))
    value = F.when(F.col("size_before").isNotNull(), 1 - F.coalesce("common", F.lit(0)) / F.greatest("size", "size_before"))
    return dates.join(stayed, ["g", "d", "last"], "left").select("g", "d", "gross", value.alias("turnover"))


def group_turnover(groups: DataFrame, by: str = "date", stock: str = "stock_code", group: str = "group") -> DataFrame:
    """group, date, turnover: 1 - common / larger membership between a group's consecutive dates; 1 without overlap."""
    return _dated(group_steps(groups, by, stock, group)).where("turnover IS NOT NULL").select(F.col("g").alias(group), F.col("d").alias(by), "turnover")


def quantile_backtest(df: DataFrame, factor: str = "factor", ret: str = "fwd", by: str = "date", n: int = 5, cost: float = 0.003, per_period_cost: bool = False, group: str | None = None) -> DataFrame:
    """date, series (group_1.. and long_short), gross, net, nav.

    By default a group's mean turnover over the whole sample is charged each
    period and the short leg's cost is given back, as research reports often do;
    per_period_cost charges each period's own turnover, on both legs.
    """
    rows = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    rows = rows.withColumnRenamed(group, "group") if group else xs.quantile_groups(rows, factor, by, n)
    dated = _dated(group_steps(rows, by, ret=ret)).select(F.col("d").alias(by), F.col("g").alias("group"), "gross", "turnover")
    charged = F.col("turnover") if per_period_cost else F.avg("turnover").over(Window.partitionBy("group"))
    gross = dated.withColumn("fee", cost * F.coalesce(charged, F.lit(0.0))).withColumn("net", F.col("gross") - F.col("fee"))
    leg = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    short_cost = leg(1, "fee") if per_period_cost else -leg(1, "fee")
    spread = gross.groupBy(by).agg((leg(n, "gross") - leg(1, "gross")).alias("gross"), (leg(n, "gross") - leg(1, "gross") - leg(n, "fee") - short_cost).alias("net"))
    all_ = gross.select(by, F.concat(F.lit("group_"), F.col("group")).alias("series"), "gross", "net").unionByName(spread.select(by, F.lit("long_short").alias("series"), "gross", "net"))
    return wealth(all_, "net", ["series"], by)


@dataclass
class FactorReport:
    ic: DataFrame
    ic_summary: DataFrame
    returns: DataFrame
    performance: DataFrame
    turnover: DataFrame


def performance_analysis(df: DataFrame, factor: str = "factor", ret: str = "fwd", n: int = 5, cost: float = 0.003, periods: int = 12) -> FactorReport:
    """Everything a factor report shows, as lazy tables."""
    ic = xs.ic_series(df, factor, ret)
    returns = quantile_backtest(df, factor, ret, n=n, cost=cost)
    groups = xs.quantile_groups(df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull()), factor, n=n)
    return FactorReport(ic, xs.ic_summary(ic, periods), returns, performance_summary(returns, ["series"], "net", periods=periods), group_turnover(groups).groupBy("group").agg(F.avg("turnover").alias("turnover")))
