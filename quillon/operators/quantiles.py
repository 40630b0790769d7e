"""Exact quantiles by radix selection.

A double is turned into a 64-bit integer that sorts as it does. Four rounds count
the values by 16 further bits, and every wanted rank goes on in the one bin that
holds it. A round shuffles counts by bin, at most 65,536 for each prefix that is
still wanted; no round sorts or gathers values, and equal values never meet as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import table

BITS = 16
SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(T.LongType())
def sortable(x: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; negative zero is zero, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).astype("<f8").view("<i8")
    return pd.Series(np.where(bits < 0, bits ^ SIGN, bits))


@F.pandas_udf(T.DoubleType())
def unsorted_value(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ SIGN, bits).view("<f8"))


def _narrowed(bins: DataFrame, by: str) -> DataFrame:
    """bins: by, _bin, _before and _c (values before the bin and in it), _wanted. The bins that hold a wanted rank, with the ranks within them."""
    rows = bins.select(by, "_bin", "_before", "_c", F.explode("_wanted").alias("_w")).where("_w.rank >= _before AND _w.rank < _before + _c")
    rank = F.struct(F.col("_w.i").alias("i"), F.col("_w.end").alias("end"), (F.col("_w.rank") - F.col("_before")).alias("rank"), F.col("_w.share").alias("share"))
    return rows.groupBy(by, F.col("_bin").alias("_prefix")).agg(F.collect_list(rank).alias("_wanted"))


def exact_quantiles(df: DataFrame, by: str, value: str, probs: Sequence[float]) -> DataFrame:
    """by, q0, q1, ...: interpolated quantiles as percentile gives them; null values don't count, groups without values have no row."""
    keys = table(df.where(F.col(value).isNotNull()).select(by, sortable(F.col(value).cast("double")).alias("_key")), "quantile_keys")
    shift = 64 - BITS
    bins = keys.groupBy(by, F.shiftright("_key", shift).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    upto = lambda *own: F.sum("_c").over(Window.partitionBy(*own).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = lambda p: (F.sum("_c").over(Window.partitionBy(by)) - 1) * F.lit(float(p))
    ends = [F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), f(place(p)).cast("long").alias("rank"), (place(p) - F.floor(place(p))).alias("share")) for i, p in enumerate(probs) for end, f in (("lo", F.floor), ("hi", F.ceil))]
    bins = bins.select(by, "_bin", "_c", (upto(by) - F.col("_c")).alias("_before"), F.array(*ends).alias("_wanted"))
    while True:
        wanted = _narrowed(bins, by)
        if not shift:
            break
        wanted, shift = table(wanted, "quantile_ranks"), shift - BITS  # a few rows a group, of a size that the planner knows
        near = keys.withColumn("_prefix", F.shiftright("_key", shift + BITS)).join(wanted, [by, "_prefix"])
        bins = near.groupBy(by, "_prefix", F.shiftright("_key", shift).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.any_value("_wanted").alias("_wanted"))
        bins = bins.withColumn("_before", upto(by, "_prefix") - F.col("_c"))
    found = wanted.select(by, unsorted_value("_prefix").alias("_value"), F.explode("_wanted").alias("_w"))
    at = lambda i, end: F.max(F.when((F.col("_w.i") == i) & (F.col("_w.end") == end), F.col("_value")))
    share = lambda i: F.max(F.when(F.col("_w.i") == i, F.col("_w.share")))
    return found.groupBy(by).agg(*[F.when(at(i, "lo") == at(i, "hi"), at(i, "lo")).otherwise(at(i, "lo") + (at(i, "hi") - at(i, "lo")) * share(i)).alias(f"q{i}") for i in range(len(probs))])
