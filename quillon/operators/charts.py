"""Tables behind the charts and reference tables of a report; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import annual_return
from ..functions.statistics import cumulative


def ic_by_month(ic: DataFrame, value: str = "ic", counts: Sequence[str] = ("candidates", "valid", "missing")) -> DataFrame:
    """model, month, ic (mean over the paths of each path's mean), paths, the counts and their rates. ic: model, path, date."""
    by_path = ic.groupBy("model", "path", F.trunc("date", "month").alias("month")).agg(F.avg(value).alias("ic"), *[F.sum(c).alias(c) for c in counts])
    out = by_path.groupBy("model", "month").agg(F.avg("ic").alias("ic"), F.count_distinct("path").alias("paths"), *[F.sum(c).alias(c) for c in counts])
    return out.withColumns({f"{c}_rate": F.try_divide(F.col(c), F.col(counts[0])) for c in counts[1:]})


def ic_cumulative(ic: DataFrame, value: str = "ic", by: Sequence[str] = ("model",)) -> DataFrame:
    """ic with its running sum within each series; a missing value adds nothing."""
    return ic.withColumn("cumulative", F.sum(value).over(cumulative(Window.partitionBy(*by).orderBy("date"))))


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ("model",)) -> DataFrame:
    """by, bin (from 0), low, high, n: equal bins from least to greatest, the last one closed; empty bins are left out."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = df.where(F.col(value).isNotNull()).join(ends, list(by))
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1))
    rows = rows.withColumn("bin", F.coalesce(at, F.lit(0)).cast("long"))
    out = rows.groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def group_wealth(path_nav: DataFrame, groups: Sequence[int] | None = None) -> DataFrame:
    """model, group, date, nav (mean over paths), paths, cumulative_return; path_nav: model, group, path, date, nav."""
    rows = path_nav if groups is None else path_nav.where(F.col("group").isin(list(groups)))
    out = rows.groupBy("model", "group", "date").agg(F.avg("nav").alias("nav"), F.count_distinct("path").alias("paths"))
    return out.withColumn("cumulative_return", F.col("nav") - 1)


def group_bars(returns: DataFrame, ret: str = "net", periods: int = 12) -> DataFrame:
    """series, annual_return of every group."""
    return returns.where("series LIKE 'group%'").groupBy("series").agg(annual_return(F.col(ret), periods).alias("annual_return"))


def wealth_comparison(returns: DataFrame, n: int) -> DataFrame:
    """date, leg (long, short, long_short), nav."""
    leg = F.when(F.col("series") == f"group_{n}", "long").when(F.col("series") == "group_1", "short").when(F.col("series") == "long_short", "long_short")
    return returns.select("date", leg.alias("leg"), "nav").where("leg IS NOT NULL")


def scatter_points(predictions: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """At most limit complete pairs, those with the least hashes: for display, so the limit is the feature."""
    rows = predictions.where(F.col("prediction").isNotNull() & F.col("label").isNotNull()).select("model", "stock_code", "date", "prediction", "label")
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "model", "stock_code", "date")), "model", "stock_code", "date").limit(limit)


def annual_rows(path_metrics: DataFrame, portfolios: Sequence) -> DataFrame:
    """The yearly rows of the named portfolios."""
    return path_metrics.where(F.col("portfolio").isin(list(portfolios)) & (F.col("period") != "all"))


def resource_usage(resources: DataFrame) -> DataFrame:
    """Adds display_memory_bytes and _scope (the device's, where measured, else the process's) and wiring; a missing wiring is dense."""
    device = F.col("device_memory_bytes").isNotNull()
    return resources.withColumns({
        "display_memory_bytes": F.when(device, F.col("device_memory_bytes")).otherwise(F.col("process_memory_bytes")),
        "display_memory_scope": F.when(device, F.lit("device")).otherwise(F.lit("process")),
        "wiring": F.when(F.coalesce("is_sparse_wiring", F.lit(False)), "sparse").otherwise("dense"),
    })


def deviations(reported: DataFrame, reproduced: DataFrame, keys: Sequence[str], values: Sequence[str], elements: DataFrame | None = None) -> DataFrame:
    """Every reported row with report_<value>, <value> as reproduced (null where it wasn't) and the difference.

    elements: keys to element_id, names of the report's elements.
    """
    left = reported.select(*keys, *[F.col(v).alias(f"report_{v}") for v in values])
    out = left.join(reproduced.select(*keys, *values), list(keys), "left")
    out = out.withColumns({f"{v}_deviation": F.col(v) - F.col(f"report_{v}") for v in values})
    return out if elements is None else out.join(elements, [k for k in keys if k in elements.columns], "left")


def metrics_document(spark, report_id: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row: a JSON document of small tables, each an array of records in a stable order.

    The tables are summaries (a row for each model, portfolio and period); their size doesn't follow the data's.
    """
    one = spark.range(1).select(F.lit(report_id).alias("report_id"))
    for name, table in parts.items():
        records = table.agg(F.sort_array(F.collect_list(F.struct(*table.columns))).alias(name))
        one = one.withColumn("_k", F.lit(1)).join(records.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.select(F.to_json(F.struct("report_id", *parts)).alias("document"))
