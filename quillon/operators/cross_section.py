"""Operators over the cross-section of each date: one shuffle by date, the rest are windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .comoments import co_deviation, comoments
from ..functions.statistics import average_rank, clean, safe_corr


def winsorize(df: DataFrame, col: str, by: str = "date", out: str | None = None, method: str = "mad", n_sigma: float = 3.0, scale: float = 1.4826) -> DataFrame:
    """Clips to centre +- n_sigma spreads of the date: median and MAD, or mean and standard deviation.

    A MAD of zero sends all values to the median; a date without values stays as it is.
    """
    w, x = Window.partitionBy(by), F.col(col)
    if method == "mad":
        df = df.withColumn("_mid", F.median(x).over(w))
        df = df.withColumn("_spread", F.median(F.abs(x - F.col("_mid"))).over(w) * scale)
    elif method == "std":
        df = df.withColumn("_mid", F.avg(x).over(w)).withColumn("_spread", F.stddev_samp(x).over(w))
    else:
        raise ValueError(f"unknown method {method}")
    reach = F.lit(n_sigma) * F.col("_spread")
    clipped = F.when(reach.isNull(), x).otherwise(F.least(F.greatest(x, F.col("_mid") - reach), F.col("_mid") + reach))
    return df.withColumn(out or col, F.when(x.isNotNull(), clipped)).drop("_mid", "_spread")


def standardize(df: DataFrame, col: str, by: str = "date", out: str | None = None) -> DataFrame:
    """z-scores of the date; a constant date gives 0, a single value null."""
    w, x = Window.partitionBy(by), F.col(col)
    spread = F.stddev_samp(x).over(w)
    z = F.when(spread == 0, x * 0).otherwise((x - F.avg(x).over(w)) / F.when(spread != 0, spread))
    return df.withColumn(out or col, z)


def neutralize(df: DataFrame, col: str, cap: str = "market_cap", industry: str = "industry", by: str = "date", out: str | None = None) -> DataFrame:
    """Residuals of the date's regression on log capitalisation and industry dummies.

    Means are taken out within each industry first, so a single slope remains: no
    matrix is built. A missing industry counts as the date's first; rows without
    capitalisation get null; where a date has no more rows than regressors the
    values stay as they are.
    """
    w = Window.partitionBy(by)
    x = F.col(col)
    used = x.isNotNull() & F.col(cap).isNotNull()
    df = df.withColumn("_ind", F.when(used, F.coalesce(F.col(industry), F.min(F.when(used, F.col(industry))).over(w), F.lit(0))))
    df = df.withColumn("_lc", F.when(used, F.ln(F.greatest(F.col(cap), F.lit(1.0))))).withColumn("_f", F.when(used, x))
    group = Window.partitionBy(by, "_ind")
    df = df.withColumn("_fd", F.col("_f") - F.avg("_f").over(group)).withColumn("_xd", F.col("_lc") - F.avg("_lc").over(group))
    slope = F.coalesce(F.try_divide(F.sum(F.col("_fd") * F.col("_xd")).over(w), F.sum(F.col("_xd") * F.col("_xd")).over(w)), F.lit(0.0))
    rows = F.count("_f").over(w)
    columns = F.size(F.collect_set("_ind").over(w)) + 1
    value = F.when(rows <= columns, x).otherwise(F.col("_fd") - F.col("_xd") * slope)
    return df.withColumn(out or col, value).drop("_ind", "_lc", "_f", "_fd", "_xd")


def standardize_factor(df: DataFrame, col: str = "factor", by: str = "date", cap: str | None = None, industry: str | None = None, method: str = "mad", out: str = "factor_std") -> DataFrame:
    """Winsorised, neutralised where both attributes are named, then standardised."""
    df = winsorize(df, col, by, out, method)
    if cap and industry:
        df = neutralize(df, out, cap, industry, by)
    return standardize(df, out, by)


def ic_series(df: DataFrame, factor: str = "factor", ret: str = "fwd", by: list[str] | str = "date", method: str = "rank", least: int = 5) -> DataFrame:
    """by, ic, n: the correlation of complete pairs of each date, of values or of their ranks."""
    by = [by] if isinstance(by, str) else by
    pairs = df.select(*by, clean(F.col(factor)).alias("x"), clean(F.col(ret)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if method == "rank":
        pairs = pairs.select(*by, average_rank(F.col("x"), by).alias("x"), average_rank(F.col("y"), by).alias("y"))
    return pairs.groupBy(*by).agg(safe_corr(F.col("x"), F.col("y"), least).alias("ic"), F.count(F.lit(1)).alias("n"))


def ic_summary(ic: DataFrame, periods: int = 12, by: list[str] | None = None) -> DataFrame:
    """mean, std, icir, win_rate, t_stat and n of a series of correlations; 0 where they have no spread."""
    n, mean, std = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    ratio = F.when((n > 0) & (std > 0), F.try_divide(mean, std))
    zero = F.when((n == 0) | (std == 0), 0.0)
    return ic.groupBy(*(by or [])).agg(
        F.coalesce(mean, F.lit(0.0)).alias("ic_mean"),
        std.alias("ic_std"),
        F.coalesce(ratio * F.sqrt(F.lit(float(periods))), zero).alias("icir"),
        F.coalesce(F.avg((F.col("ic") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(ratio * F.sqrt(n.cast("double")), zero).alias("t_stat"),
        n.alias("n"),
    )


def _edge(m: Column, k: int, n: int) -> Column:
    """The k-th of n linear quantile edges of the ranks 1..m, interpolated from the nearer end."""
    at = (m - 1) * F.lit((k * (1.0 / n)) * 100.0 / 100.0)
    low = F.floor(at)
    part = at - low
    a, b = (low + 1).cast("double"), F.least(low + 2, m).cast("double")
    return F.when(part < 0.5, a + (b - a) * part).otherwise(b - (b - a) * (1 - part))


def quantile_groups(df: DataFrame, factor: str = "factor", by: str = "date", n: int = 5, tie: str = "stock_code", out: str = "group") -> DataFrame:
    """Ascending groups 1..n by linear quantiles of the ranks; ties by `tie`; null factors have none."""
    has = F.col(factor).isNotNull()
    order = Window.partitionBy(by, has).orderBy(factor, tie)
    df = df.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(by, has)))
    group = F.lit(1)
    for k in range(1, n):
        group = group + (F.col("_r") > _edge(F.col("_m"), k, n)).cast("int")
    return df.withColumn(out, F.when(has, group)).drop("_r", "_m")


def descending_groups(df: DataFrame, n: int = 10, by: tuple[str, ...] = ("model", "date"), value: str = "prediction", tie: str = "stock_code", out: str = "group") -> DataFrame:
    """Groups 1 (highest) to n of equal size but for one."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)
    whole = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(out, (F.floor((F.row_number().over(order) - 1) * n / whole) + 1).cast("int"))


def ols_univariate(df: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """alpha, beta, std_error, t_stat and n of y on x in each group; null where it can't be fitted."""
    a, b = clean(F.col(x)), clean(F.col(y))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    s = df.groupBy(*by).agg(
        F.count(a).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"),
        F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"), (F.min(a) < F.max(a)).alias("varies"),
    )
    fits = (F.col("n") >= least) & F.col("varies")
    beta = F.when(fits, F.try_divide(F.col("sxy"), F.col("sxx")))
    s = s.withColumn("beta", beta).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    noise = F.when(fits & (F.col("n") > 2), (F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("n") - 2))
    s = s.withColumn("std_error", F.when(noise <= 0, 0.0).otherwise(F.sqrt(F.try_divide(noise, F.col("sxx")))))
    return s.select(*by, "alpha", "beta", "std_error", F.try_divide(F.col("beta"), F.when(F.col("std_error") > 0, F.col("std_error"))).alias("t_stat"), "n")


def model_pairs(df: DataFrame, by_date: bool = False, method: str = "pearson", least: int = 5, least_unique: int = 2) -> DataFrame:
    """Correlations of unordered pairs of models over common stocks and dates, with a status.

    Pearson's over all dates are co-moments, taken in one pass; ranks and dates need the pairs' common rows.
    """
    if method == "pearson" and not by_date and least_unique == 2:
        own = df.select("model", "stock_code", "date", clean(F.col("prediction")).alias("x"))
        pairs = comoments(own, "model", ["stock_code", "date"], "x").where("row < col")
        varies = (F.col("x_low") < F.col("x_high")) & (F.col("y_low") < F.col("y_high"))
        spread = F.sqrt(co_deviation("sxx", ("sx", "sx")) * co_deviation("syy", ("sy", "sy")))
        value = F.try_divide(co_deviation(), spread)
        status = F.when(F.col("n") < least, "insufficient_common_samples").when(~varies, "constant_prediction").when(value.isNull(), "non_finite").otherwise("valid")
        return pairs.select(
            F.col("row").alias("left_model"), F.col("col").alias("right_model"), F.col("n").cast("long").alias("n"), F.when(status == "valid", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias("correlation"), status.alias("status")
        )
    a = df.select(F.col("model").alias("left_model"), "stock_code", "date", clean(F.col("prediction")).alias("x")).where("x IS NOT NULL")
    b = df.select(F.col("model").alias("right_model"), "stock_code", "date", clean(F.col("prediction")).alias("y")).where("y IS NOT NULL")
    pairs = a.join(b, ["stock_code", "date"]).where("left_model < right_model")
    by = ["left_model", "right_model"] + (["date"] if by_date else [])
    if method == "spearman":
        pairs = pairs.withColumn("rx", average_rank(F.col("x"), by)).withColumn("ry", average_rank(F.col("y"), by)).drop("x", "y").withColumnsRenamed({"rx": "x", "ry": "y"})
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.least(F.count_distinct("x"), F.count_distinct("y")).alias("u"), safe_corr(F.col("x"), F.col("y"), least).alias("correlation"))
    status = F.when(F.col("n") < least, "insufficient_common_samples").when(F.col("u") < least_unique, "constant_prediction").when(F.col("correlation").isNull(), "non_finite").otherwise("valid")
    return out.select(*by, "n", F.when(status == "valid", F.col("correlation")).alias("correlation"), status.alias("status"))


def correlation_matrix(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Long symmetric matrix: pairs, mirrored pairs and the unit diagonal."""
    one = pairs.select(F.col("left_model").alias("row"), F.col("right_model").alias("col"), "correlation")
    return one.unionByName(one.select(F.col("col").alias("row"), F.col("row").alias("col"), "correlation")).unionByName(models.select(F.col("model").alias("row"), F.col("model").alias("col"), F.lit(1.0).alias("correlation")))


def off_diagonal_range(matrix: DataFrame, value: str = "correlation") -> DataFrame:
    return matrix.where(F.col("row") != F.col("col")).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def frobenius_diversification(matrix: DataFrame, value: str = "correlation") -> DataFrame:
    """Distance of a long correlation matrix from the unit matrix."""
    gap = F.col(value) - F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)
    return matrix.agg(F.when(F.count_distinct("row") > 1, F.sqrt(F.sum(gap * gap))).otherwise(0.0).alias("distance"))
