"""Allocation: weights held between rebalance dates, and covariance estimates in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import cumulative
from .comoments import co_deviation, comoments


def equal_weights(df: DataFrame, by: str = "date", asset: str = "asset") -> DataFrame:
    return df.select(by, asset).distinct().withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(by)))


def normalize_long(df: DataFrame, weight: str = "weight", by: str = "date") -> DataFrame:
    """Negative weights to 0, the rest to sum 1; equal where nothing is left."""
    w = Window.partitionBy(by)
    positive = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    total = F.sum(positive).over(w)
    return df.withColumn(weight, F.when(total > 0, positive / F.when(total > 0, total)).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def simplex_projection(df: DataFrame, value: str = "value", by: str = "date", tie: str = "asset", out: str = "weight") -> DataFrame:
    """The nearest weights that are not negative and sum to 1, by sorting and one threshold for each date."""
    order = Window.partitionBy(by).orderBy(F.col(value).desc(), tie)
    rows = df.withColumn("_k", F.row_number().over(order)).withColumn("_s", F.sum(value).over(cumulative(order)))
    rows = rows.withColumn("_t", (F.col("_s") - 1) / F.col("_k"))
    theta = F.max_by(F.when(F.col(value) > F.col("_t"), F.col("_t")), F.when(F.col(value) > F.col("_t"), F.col("_k"))).over(Window.partitionBy(by))
    return rows.withColumn(out, F.greatest(F.col(value) - theta, F.lit(0.0))).drop("_k", "_s", "_t")


def inverse_volatility(df: DataFrame, by: list[str] | None = None, asset: str = "asset", ret: str = "ret") -> DataFrame:
    sd = df.groupBy(*(by or []), asset).agg(F.stddev_samp(ret).alias("sd")).where("sd > 0")
    return sd.withColumn("weight", 1 / F.col("sd") / F.sum(1 / F.col("sd")).over(Window.partitionBy(*(by or [F.lit(1)]))))


def covariance(df: DataFrame, asset: str = "asset", ret: str = "ret", min_obs: int = 12) -> DataFrame:
    """row, col, value. Assets with fewer than 2 observations go; with fewer than min_obs dates only variances
    (missing: their median) are used, pairs being absent, else covariances of complete pairs, null for a single one."""
    seen = df.where(F.col(ret).isNotNull())
    kept = seen.groupBy(asset).agg(F.count(F.lit(1)).alias("n"), F.var_samp(ret).alias("v")).where("n >= 2")
    if seen.select("date").distinct().limit(min_obs).count() < min_obs:
        typical = kept.agg(F.median("v")).first()[0]
        return kept.select(F.col(asset).alias("row"), F.col(asset).alias("col"), F.coalesce("v", F.lit(typical)).alias("value"))
    half = comoments(seen.join(kept.select(asset), asset, "left_semi"), asset, ["date"], ret)
    half = half.select("row", "col", F.when(F.col("n") > 1, co_deviation() / (F.col("n") - 1)).alias("value"))
    return half.unionByName(half.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def correlation_of(cov: DataFrame) -> DataFrame:
    """Correlations of a long covariance matrix, clipped to [-1, 1], with a unit diagonal."""
    var = cov.where("row = col").select(F.col("row").alias("_i"), F.greatest("value", F.lit(1e-16)).alias("_v"))
    out = cov.join(var, F.col("row") == F.col("_i")).drop("_i").withColumnRenamed("_v", "_vr")
    out = out.join(var, F.col("col") == F.col("_i")).drop("_i")
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / F.sqrt(F.col("_vr") * F.col("_v"))))
    return out.select("row", "col", F.when(F.col("row") == F.col("col"), 1.0).otherwise(value).alias("value"))


def with_ridge(cov: DataFrame, ridge: float = 1e-8) -> DataFrame:
    return cov.withColumn("value", F.col("value") + F.when(F.col("row") == F.col("col"), ridge).otherwise(0.0))


def portfolio_backtest(weights: DataFrame, returns: DataFrame, cost_bps: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """weights: date, asset, weight at rebalance dates; returns: date, asset, ret at all dates.

    Weights of T earn the return of the first date after T, and only it. Turnover compares
    with the previous weights as they drifted; a missing return counts as 0. Gives
    date (of the return), rebalance_date, gross, turnover, net, nav, a row for each rebalance
    that has a later date. by: keys of independent strategies in both tables.
    """
    keys = by or []
    moments = weights.select(*keys, F.col("date").alias("at"), F.lit(1).alias("kind")).distinct().unionByName(returns.select(*keys, F.col("date").alias("at"), F.lit(0).alias("kind")).distinct())
    moments = moments.withColumn("at_no", F.datediff("at", F.lit("1970-01-01").cast("date")))
    after = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("at_no").rangeBetween(1, Window.unboundedFollowing)
    next_ = moments.withColumn("next", F.min(F.when(F.col("kind") == 0, F.col("at"))).over(after)).where("kind = 1 AND next IS NOT NULL").select(*keys, F.col("at").alias("date"), F.col("next").alias("earn_date"))
    w = weights.join(next_, [*keys, "date"])
    r = returns.select(*keys, F.col("date").alias("earn_date"), "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    order = next_.withColumn("seq", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")))
    held = w.join(order.select(*keys, "date", "seq"), [*keys, "date"]).join(r, [*keys, "earn_date", "asset"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    held = held.withColumn("grown", F.col("weight") * (1 + F.col("ret")))
    total = F.sum("grown").over(Window.partitionBy(*keys, "date"))
    held = held.withColumn("drifted", F.when(total > 0, F.col("grown") / F.when(total > 0, total)).otherwise(F.col("weight")))
    before = held.select(*keys, (F.col("seq") + 1).alias("seq"), "asset", F.col("drifted").alias("before"))
    both = held.select(*keys, "seq", "asset", "weight", "ret").join(before, [*keys, "seq", "asset"], "full")
    sums = both.groupBy(*keys, "seq").agg(
        F.sum(F.coalesce(F.col("weight") * F.col("ret"), F.lit(0.0))).alias("gross"),
        F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("turnover"),
    )
    out = order.join(sums, [*keys, "seq"]).withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)
    upto = cumulative(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date"))
    out = out.withColumn("nav", F.product(1 + F.col("net")).over(upto))
    return out.select(*keys, F.col("date").alias("rebalance_date"), F.col("earn_date").alias("date"), "gross", "turnover", "net", "nav")
