"""Market views derived from the test tables, each with the same view in SQL.

Averages are rounded where ranks or ties depend on them, so that two engines that
add in another order still see the same ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code, date (month), factor, px, volume, fwd: suppliers by month."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("stock_code"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"))
        .agg(
            F.round(F.avg("l_discount"), 10).alias("factor"),
            F.round(F.sum(net) / F.sum("l_quantity"), 8).alias("px"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    own = Window.partitionBy("stock_code").orderBy("date")
    return monthly.withColumn("fwd", F.round(F.lead("px").over(own) / F.col("px") - 1, 10))


PANEL = """panel AS (
 SELECT *, round(lead(px) OVER (PARTITION BY stock_code ORDER BY date) / px - 1, 10) AS fwd FROM (
  SELECT l_suppkey AS stock_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(avg(l_discount), 10) AS factor,
         round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 8) AS px, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2))"""


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code, industry, market_cap; some of both are missing by rule."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("stock_code"),
        F.when(F.col("s_suppkey") % 11 != 3, F.col("s_nationkey") % 5).cast("int").alias("industry"),
        F.when(F.col("s_suppkey") % 17 != 5, F.abs("s_acctbal")).alias("market_cap"),
    )


ATTRIBUTES = """attributes AS (
 SELECT s_suppkey AS stock_code, CASE WHEN s_suppkey % 11 <> 3 THEN CAST(s_nationkey % 5 AS INT) END AS industry,
        CASE WHEN s_suppkey % 17 <> 5 THEN abs(s_acctbal) END AS market_cap FROM supplier)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, stock_code, date, prediction: three pseudo-models over the panel."""
    lines = table(spark, sf_dir, "lineitem")
    means = lines.groupBy(F.col("l_suppkey").alias("stock_code"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(
        *[F.round(F.avg(c), 10).alias(m) for m, c in MODELS.items()]
    )
    return means.unpivot(["stock_code", "date"], list(MODELS), "model", "prediction").select("model", "stock_code", "date", "prediction")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, stock_code, date, prediction, label: the scores with the panel's next return."""
    labels = panel(spark, sf_dir).select("stock_code", "date", F.col("fwd").alias("label"))
    return scores(spark, sf_dir).join(labels, ["stock_code", "date"], "left").select("model", "stock_code", "date", "prediction", "label")


MODELS = {"disc": "l_discount", "qty": "l_quantity", "tax": "l_tax"}
PREDICTIONS = """predictions AS (
 SELECT s.model, s.stock_code, s.date, s.prediction, p.fwd AS label FROM (
  SELECT 'disc' AS model, l_suppkey AS stock_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(avg(l_discount), 10) AS prediction FROM lineitem GROUP BY 2, 3
  UNION ALL SELECT 'qty', l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE), round(avg(l_quantity), 10) FROM lineitem GROUP BY 2, 3
  UNION ALL SELECT 'tax', l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE), round(avg(l_tax), 10) FROM lineitem GROUP BY 2, 3) s
 LEFT JOIN panel p ON p.stock_code = s.stock_code AND p.date = s.date)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, value, ret, signal: order totals by day for each priority."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    own = Window.partitionBy("series_id").orderBy("date")
    ret = F.round((F.col("value") / F.lag("value").over(own) - 1) / 2000, 10)
    trailing = F.avg("value").over(own.rowsBetween(-20, -1))
    return daily.withColumn("ret", ret).withColumn("signal", F.when(F.col("value") > trailing, 1.0).when(F.col("value") < trailing, 0.0))


SERIES = """series AS (
 SELECT *, round((value / lag(value) OVER w - 1) / 2000, 10) AS ret,
  CASE WHEN value > avg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1.0::DOUBLE
       WHEN value < avg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 0.0::DOUBLE END AS signal
 FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY series_id ORDER BY date))"""


def asset_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset (nation), date (month), ret."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    monthly = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").cast("long").alias("asset"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"))
        .agg((F.sum(net) / F.sum("l_quantity")).alias("px"))
    )
    own = Window.partitionBy("asset").orderBy("date")
    return monthly.select("asset", "date", F.round(F.col("px") / F.lag("px").over(own) - 1, 10).alias("ret")).where("ret IS NOT NULL")


ASSETS = """assets AS (SELECT asset, date, ret FROM (
 SELECT asset, date, round(px / lag(px) OVER (PARTITION BY asset ORDER BY date) - 1, 10) AS ret FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS px
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)) WHERE ret IS NOT NULL)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, trade_index of the panel's months: one small row set, numbered from 0."""
    months = table(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).distinct()
    return months.withColumn("trade_index", F.row_number().over(Window.orderBy("date")).cast("long") - 1)


CALENDAR = """calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS trade_index FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem))"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, start, stop (null: open): every third order of a customer begins an interval that the next order ends."""
    own = Window.partitionBy("code").orderBy("start", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("start"), "o_orderkey")
    o = o.withColumn("stop", F.lead("start").over(own)).where((F.col("o_orderkey") % 3 == 0) & (F.col("stop").isNull() | (F.col("stop") > F.col("start"))))
    return o.select("code", "start", "stop")


INTERVALS = """intervals AS (SELECT code, start, stop FROM (
 SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS start, o_orderkey, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS stop FROM orders)
 WHERE o_orderkey % 3 = 0 AND (stop IS NULL OR stop > start))"""


def customer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date: days on which customers ordered."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("date")).distinct()


DAYS = """days AS (SELECT DISTINCT o_custkey AS code, CAST(o_orderdate AS DATE) AS date FROM orders)"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, if_suspend, limit_flag: users by day, from events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("code"), F.col("ts").cast("date").alias("date")).agg(
        F.max(F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 0)).alias("if_suspend"),
        F.max((F.col("event_type") == "signup").cast("int")).alias("limit_flag"),
    )


STATUS = """status AS (SELECT user_id AS code, CAST(ts AS DATE) AS date,
 max(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'click' THEN 0 END) AS if_suspend, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS limit_flag
 FROM events GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code, date, prev_close, open, high, low, close, volume, turnover, close_forward: parts by month as bars."""
    lines = table(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    made = lines.groupBy(F.col("l_suppkey").alias("stock_code"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(
        F.round(F.min(unit), 6).alias("low"), F.round(F.max(unit), 6).alias("high"), F.round(F.avg(unit), 6).alias("close"),
        F.round((F.min(unit) + F.max(unit)) / 2, 6).alias("open"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 4).alias("turnover"),
    )
    own = Window.partitionBy("stock_code").orderBy("date")
    return made.withColumn("prev_close", F.lag("close").over(own)).withColumn("close_forward", F.round(F.col("close") * (1 + F.col("stock_code") % 3), 6))


BARS = """bars AS (SELECT *, lag(close) OVER (PARTITION BY stock_code ORDER BY date) AS prev_close, round(close * (1 + stock_code % 3), 6) AS close_forward FROM (
 SELECT l_suppkey AS stock_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(min(l_extendedprice / l_quantity), 6) AS low,
  round(max(l_extendedprice / l_quantity), 6) AS high, round(avg(l_extendedprice / l_quantity), 6) AS close,
  round((min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2, 6) AS open, sum(l_quantity) AS volume, round(sum(l_extendedprice), 4) AS turnover
 FROM lineitem GROUP BY 1, 2))"""


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, IfTradingDay (not on Sundays), IfMonthEnd (the month's last trading day): days with orders."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    days = days.withColumn("IfTradingDay", (F.dayofweek("date") != 1).cast("int"))
    last = F.max(F.when(F.col("IfTradingDay") == 1, F.col("date"))).over(Window.partitionBy(F.trunc("date", "month")))
    return days.withColumn("IfMonthEnd", F.coalesce((F.col("date") == last).cast("int"), F.lit(0)))


CALENDAR_DAYS = """calendar_days AS (SELECT date, is_trading, CASE WHEN date = max(CASE WHEN is_trading = 1 THEN date END) OVER (PARTITION BY date_trunc('month', date)) THEN 1 ELSE 0 END AS is_month_end
 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CASE WHEN dayofweek(CAST(o_orderdate AS DATE)) <> 0 THEN 1 ELSE 0 END AS is_trading FROM orders))"""


def _industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards 37 and 38; a second name in 37 for every fifth stock."""
    a = attributes(spark, sf_dir)
    named = a.where("industry IS NOT NULL").select("stock_code", F.explode(F.array(F.lit(37), F.lit(38))).alias("standard_code"), F.concat(F.lit("sector "), "industry").alias("first_industry_name"))
    return named.unionByName(a.where("stock_code % 5 = 0").select("stock_code", F.lit(37).alias("standard_code"), F.lit("agriculture").alias("first_industry_name")))


def _text(*columns: str) -> list:
    """Dates as text, as market files often hold them."""
    return [F.col(c).cast("string").alias(c) for c in columns]


MARKET = {
    "stock_price": lambda s, d: bars(s, d).select("stock_code", *_text("date"), "open", "high", "low", "close"),
    "stock_price_forward": lambda s, d: bars(s, d).select("stock_code", *_text("date"), F.col("close_forward").alias("close")),
    "stock_trade": lambda s, d: bars(s, d).select("stock_code", *_text("date"), "volume", "turnover"),
    "stock_suspend": lambda s, d: status(s, d).select(F.col("code").alias("stock_code"), "date", "if_suspend"),
    "stock_limit": lambda s, d: status(s, d).select(F.col("code").alias("stock_code"), "date", "limit_flag"),
    "stock_st": lambda s, d: intervals(s, d).withColumnsRenamed({"code": "stock_code", "start": "implement_date", "stop": "remove_date"}).select("stock_code", *_text("implement_date", "remove_date")),
    "index_components": lambda s, d: intervals(s, d).withColumnsRenamed({"code": "stock_code", "start": "in_date", "stop": "out_date"}).select(F.when(F.col("stock_code") % 2 == 0, "000300").otherwise("000905").alias("index_code"), "stock_code", *_text("in_date", "out_date")),
    "stock_industry": _industries,
    "calendar": lambda s, d: calendar_days(s, d).select(*_text("date"), "IfTradingDay", "IfMonthEnd"),
}


def market_root(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A new root in the shared folder that holds the named market tables, written from the test tables."""
    root = folder(spark, "market")
    for name in names:
        MARKET[name](spark, sf_dir).write.parquet(f"{root}/{name}.parquet")
    return root
