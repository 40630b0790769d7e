"""Point-in-time universes: filters by status, interval and membership, for all dates at once.

Interval conditions always ride on an equality of codes, so they run as hash or
sort-merge joins with a residual and never as nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covers(date: Column, start: Column, stop: Column) -> Column:
    """date in [start, stop); a null stop is open."""
    return (start <= date) & (stop.isNull() | (date < stop))


def filter_suspended(panel: DataFrame, status: DataFrame, code: str = "stock_code", date: str = "date", flag: str = "if_suspend") -> DataFrame:
    """Rows but those flagged 1; an unknown status is kept."""
    return panel.join(status.where(F.col(flag) == 1).select(code, date).distinct(), [code, date], "left_anti")


def outside_intervals(rows: DataFrame, intervals: DataFrame, code: str = "code", date: str = "date", start: str = "start", stop: str = "stop") -> DataFrame:
    held = intervals.select(F.col(code).alias("_c"), F.col(start).alias("_s"), F.col(stop).alias("_e"))
    return rows.join(held, (F.col(code) == F.col("_c")) & covers(F.col(date), F.col("_s"), F.col("_e")), "left_anti")


def inside_intervals(rows: DataFrame, intervals: DataFrame, code: str = "code", date: str = "date", start: str = "start", stop: str = "stop") -> DataFrame:
    held = intervals.select(F.col(code).alias("_c"), F.col(start).alias("_s"), F.col(stop).alias("_e"))
    return rows.join(held, (F.col(code) == F.col("_c")) & covers(F.col(date), F.col("_s"), F.col("_e")), "left_semi")


def universe(rows: DataFrame, st: DataFrame | None, members: DataFrame | None = None, **names: str) -> DataFrame:
    """Distinct code and date, without those in `st` and, if members are given, only those in `members`."""
    code, date = names.get("code", "code"), names.get("date", "date")
    out = rows.select(code, date).distinct()
    if st is not None:
        out = outside_intervals(out, st, **names)
    return inside_intervals(out, members, **names) if members is not None else out


def listed_universe(rows: DataFrame, master: DataFrame, st: DataFrame, minimum_years: int = 1, code: str = "code", date: str = "date") -> DataFrame:
    """Adds list_date, eligible_from, is_st and eligible_signal; an unknown list date is the first bar."""
    first = rows.groupBy(code).agg(F.min(date).alias("_first"))
    listed = first.join(master.select(F.col(code), F.col("list_date").alias("_list")), code, "left")
    listed = listed.select(code, F.coalesce("_list", "_first").alias("list_date"))
    out = rows.join(listed, code).withColumn("eligible_from", F.add_months("list_date", 12 * minimum_years))
    held = st.select(F.col(code).alias("_c"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    marked = out.select(code, date).distinct().join(held, (F.col(code) == F.col("_c")) & covers(F.col(date), F.col("_s"), F.col("_e")), "left_semi").withColumn("is_st", F.lit(True))
    out = out.join(marked, [code, date], "left").withColumn("is_st", F.coalesce("is_st", F.lit(False)))
    return out.withColumn("eligible_signal", (F.col(date) >= F.col("eligible_from")) & ~F.col("is_st"))


def entry_tradability(samples: DataFrame, status: DataFrame, code: str = "code", entry: str = "entry_date") -> DataFrame:
    """Adds the flags of the entry date (unknown: 0) and tradable."""
    s = status.select(F.col(code).alias("_c"), F.col("date").alias("_d"), F.col("if_suspend").alias("_f"), F.col("limit_flag").alias("_l"))
    out = samples.join(s, (F.col(code) == F.col("_c")) & (F.col(entry) == F.col("_d")), "left")
    out = out.withColumn("entry_suspend", F.coalesce("_f", F.lit(0))).withColumn("entry_limit", F.coalesce("_l", F.lit(0))).drop("_c", "_d", "_f", "_l")
    return out.withColumn("tradable", (F.col("entry_suspend") != 1) & (F.col("entry_limit") != 1))
