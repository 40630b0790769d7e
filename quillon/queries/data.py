"""Queries of sources, universes, features and labels, with SQL."""

from __future__ import annotations

import uuid
from datetime import date as Date

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import universe as un
from ..operators import validate, windows
from ..sources import market, store
from ..sources import synthetic as syn
from ..sources.synthetic import BARS, CALENDAR, DAYS, INTERVALS, PANEL, PREDICTIONS, STATUS
from .cross_section import _r, _with


def pushdown_scan(spark, d):
    rows = market.load(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"], dates=("o_orderdate",), codes=[1, 2, 3, 5, 8, 13], start="1996-01-01", end="1999-12-31", code_col="o_custkey", date_col="o_orderdate")
    return rows.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("date"))


def market_inner_merge(spark, d):
    p = syn.panel(spark, d)
    return market.market_data(p.select("stock_code", "date", "px"), p.where("stock_code % 3 <> 0").select("stock_code", "date", "volume"), "1997-06-01", "1998-06-30").select("stock_code", "date", "px", "volume")


def calendar_month_end(spark, d):
    days = syn.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("month_end"), F.count(F.lit(1)).alias("days"))


def market_store(spark, d):
    """Prices and trades from the bucketed store, and each stock's last price before; neither the join nor the window has an exchange."""
    store.open_session(spark)
    p, run = syn.panel(spark, d), uuid.uuid4().hex
    price = store.save(p.select("stock_code", "date", "px"), f"price_{run}", 8)
    trade = store.save(p.where("stock_code % 3 <> 0").select("stock_code", "date", "volume"), f"trade_{run}", 8)
    rows = store.merged(price, trade, "1997-06-01", "1998-06-30", market.LOOK_BACK_DAYS)
    return rows.select("stock_code", "date", "px", "volume", F.lag("px").over(Window.partitionBy("stock_code").orderBy("date")).alias("before"))


def suspend_anti(spark, d):
    rows = syn.table(spark, d, "events").select(F.col("user_id").alias("code"), F.col("ts").cast("date").alias("date"), "event_id")
    return un.filter_suspended(rows, syn.status(spark, d), "code").select("code", "date", "event_id")


def interval_anti_st(spark, d):
    return un.outside_intervals(syn.customer_days(spark, d), syn.intervals(spark, d))


def interval_semi_members(spark, d):
    return un.inside_intervals(syn.customer_days(spark, d), syn.intervals(spark, d))


def universe_all_dates(spark, d):
    held = syn.intervals(spark, d)
    return un.universe(syn.customer_days(spark, d), held.where("code % 2 = 0"), held.where("code % 3 <> 0"))


def listed_universe(spark, d):
    master = syn.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.when(F.col("c_custkey") % 4 == 0, F.to_date(F.lit("1996-02-29"))).alias("list_date"))
    out = un.listed_universe(syn.customer_days(spark, d), master, syn.intervals(spark, d))
    return out.select("code", "date", "list_date", "eligible_from", "is_st", "eligible_signal")


def entry_tradability(spark, d):
    samples = syn.table(spark, d, "events").select(F.col("user_id").alias("code"), F.date_add(F.col("ts").cast("date"), 1).alias("entry_date"), "event_id")
    return un.entry_tradability(samples, syn.status(spark, d)).select("event_id", F.col("entry_suspend").cast("long").alias("entry_suspend"), F.col("entry_limit").cast("long").alias("entry_limit"), "tradable")


def factor_panel_clean(spark, d):
    raw = syn.predictions(spark, d).withColumn("prediction", F.when(F.col("stock_code") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("prediction")))
    return validate.prepare_factor_panel(raw, 90, 3).select("model", "stock_code", "date", "prediction", "label")


def price_volume_features(spark, d):
    out = ft.build_features(syn.bars(spark, d))
    return out.select("stock_code", "date", *[_r(f"f_{c}", 6) for c in ("open", "high", "low", "close", "volume", "turnover")])


def adj_vwap(spark, d):
    return ft.forward_adjusted_vwap(syn.bars(spark, d), 0.9, 1.1).select("stock_code", "date", "checked", "passed", _r("vwap", 5))


def vwap_diagnostics(spark, d):
    return ft.vwap_diagnostics(ft.forward_adjusted_vwap(syn.bars(spark, d), 0.9, 1.1)).select("checked", "passed", _r("fraction"), _r("median_ratio", 6))


def _labelled(spark, d):
    return ft.forward_labels(syn.panel(spark, d).where("stock_code % 7 <> 0 OR month(date) <> 5"), syn.calendar(spark, d), "px")


def forward_labels(spark, d):
    return _labelled(spark, d).select("stock_code", "date", "entry_date", "exit_date", _r("label", 6))


def window_index(spark, d):
    rows = syn.panel(spark, d).where("stock_code % 7 <> 0 OR month(date) <> 5")
    out = ft.window_index(rows, syn.calendar(spark, d), ["factor", "fwd"], 6)
    return out.select("stock_code", "date", "row_start", "row_end", "window_valid")


SEGMENTS = [ft.Segment("train", Date(1995, 1, 1), Date(1998, 6, 30)), ft.Segment("valid", Date(1998, 7, 1), Date(1999, 12, 31)), ft.Segment("test", Date(2000, 1, 1), Date(2001, 12, 31))]


def split_assign(spark, d):
    return ft.assign_splits(_labelled(spark, d), SEGMENTS).select("stock_code", "date", "split")


def quality_summary(spark, d):
    return ft.split_quality(ft.assign_splits(_labelled(spark, d), SEGMENTS)).select("split", "first_date", "last_date", "rows", "missing_labels", _r("missing_rate"))


def rows_used(spark, d):
    rows = syn.panel(spark, d).withColumn("ends", F.col("stock_code") % 5 == F.month("date") % 5)
    return ft.rows_used(rows, 3, "ends").select("stock_code", "date", "used")


def fit_preprocessor(spark, d):
    return ft.fit_preprocessor(syn.panel(spark, d), ["factor", "px", "fwd"]).select("feature", *[_r(c, 6) for c in ("low", "high", "mean", "std")])


def transform_features(spark, d):
    p = syn.panel(spark, d)
    return ft.transform_features(p, ft.fit_preprocessor(p, ["factor", "px"]), ["factor", "px"]).select("stock_code", "date", _r("factor", 5), _r("px", 5))


def window_tensor(spark, d):
    rows = ft.window_index(syn.panel(spark, d), syn.calendar(spark, d), ["factor", "fwd"], 6)
    return ft.window_tensor(rows, ["factor", "fwd"], 6).select("stock_code", "date", "window")


def window_tensor_rows(spark, d):
    """The tensors of window_tensor, a row for each step."""
    made = window_tensor(spark, d).select("stock_code", "date", F.posexplode("window").alias("step", "x"))
    return made.select("stock_code", "date", F.col("step").cast("long").alias("step"), F.col("x")[0].alias("factor"), F.col("x")[1].alias("fwd"))


def _steps(code, dates, x):
    n, length, _ = x.shape
    return pd.DataFrame({"stock_code": code, "date": np.repeat(dates, length), "step": np.tile(np.arange(length), n), "factor": x[:, :, 0].ravel(), "fwd": x[:, :, 1].ravel()})


def window_block_rows(spark, d):
    """window_tensor_rows from blocks, whose windows are views."""
    rows = ft.window_index(syn.panel(spark, d), syn.calendar(spark, d), ["factor", "fwd"], 6)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("stock_code", "date").schema) + ", step long, factor double, fwd double"
    return windows.map_windows(windows.window_blocks(rows, ["factor", "fwd"], 6), 6, _steps, schema)


def learning_data(spark, d):
    made = ft.prepare_learning_data(syn.panel(spark, d), syn.calendar(spark, d), SEGMENTS, ["factor", "fwd"], 6, ["train", "valid"], ["test"], price="px")
    return made.samples.select("stock_code", "date", "split", _r("label", 6), _r("factor", 5), _r("fwd", 5))


def deterministic_sample(spark, d):
    return validate.deterministic_sample(syn.panel(spark, d).select("stock_code", "date"), ["stock_code", "date"], 50, 7)


QUERIES = {f.__name__: f for f in (pushdown_scan, market_inner_merge, market_store, calendar_month_end, suspend_anti, interval_anti_st, interval_semi_members, universe_all_dates, listed_universe, entry_tradability, factor_panel_clean, price_volume_features, adj_vwap, vwap_diagnostics, forward_labels, window_index, split_assign, quality_summary, rows_used, fit_preprocessor, transform_features, window_tensor, window_tensor_rows, window_block_rows, learning_data, deterministic_sample)}

_IN = "EXISTS (SELECT 1 FROM {t} i WHERE i.code = d.code AND i.start <= d.date AND (i.stop IS NULL OR d.date < i.stop))"
_KEPT = "kept AS (SELECT * FROM panel WHERE stock_code % 7 <> 0 OR month(date) <> 5)"
_LABELS = """labelled AS (SELECT k.stock_code, k.date, e.date AS entry_date, x.date AS exit_date, b.px / a.px - 1 AS label FROM kept k JOIN calendar c ON c.date = k.date
 LEFT JOIN calendar e ON e.trade_index = c.trade_index + 1 LEFT JOIN calendar x ON x.trade_index = c.trade_index + 4
 LEFT JOIN kept a ON a.stock_code = k.stock_code AND a.date = e.date LEFT JOIN kept b ON b.stock_code = k.stock_code AND b.date = x.date)"""
_SPLIT = "split AS (SELECT *, CASE " + " ".join(f"WHEN date BETWEEN '{s.start}' AND '{s.end}' AND entry_date BETWEEN '{s.start}' AND '{s.end}' AND exit_date BETWEEN '{s.start}' AND '{s.end}' THEN '{s.name}'" for s in SEGMENTS) + " END AS split FROM labelled)"
_VWAP = """v1 AS (SELECT *, coalesce(turnover > 0 AND volume > 0 AND close > 0 AND close_forward > 0 AND low > 0 AND high > 0, false) AS checked FROM bars),
v2 AS (SELECT *, CASE WHEN checked THEN turnover / volume END AS raw FROM v1), v3 AS (SELECT *, coalesce(raw BETWEEN low * 0.9 AND high * 1.1 AND raw / close BETWEEN 0.9 AND 1.1, false) AS passed FROM v2),
v4 AS (SELECT *, CASE WHEN passed THEN raw * close_forward / close END AS vwap FROM v3)"""
_WINDOWS = "windows AS (SELECT stock_code, k.date, row_number() OVER w AS row_end, trade_index - lag(trade_index, 5) OVER w AS gap FROM {t} k JOIN calendar c ON c.date = k.date WHERE factor IS NOT NULL AND fwd IS NOT NULL WINDOW w AS (PARTITION BY stock_code ORDER BY k.date))"
_FITTED = """cut AS (SELECT feature, quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.99) AS high FROM long GROUP BY 1),
fitted AS (SELECT feature, low, high, avg(least(greatest(x, low), high)) AS mean, stddev_pop(least(greatest(x, low), high)) AS std FROM long JOIN cut USING (feature) GROUP BY 1, 2, 3)"""
_FIT = "long AS (SELECT 'factor' AS feature, factor AS x FROM panel UNION ALL SELECT 'px', px FROM panel UNION ALL SELECT 'fwd', fwd FROM panel WHERE fwd IS NOT NULL),\n" + _FITTED
_SAMPLES = """samples AS (SELECT w.stock_code, w.date, p.factor, p.fwd, s.split, s.label, coalesce(w.gap = 5 AND s.split IS NOT NULL AND (s.label IS NOT NULL OR s.split = 'test'), false) AS sample
  FROM windows w JOIN panel p ON p.stock_code = w.stock_code AND p.date = w.date JOIN split s ON s.stock_code = w.stock_code AND s.date = w.date),
marked AS (SELECT *, max(CASE WHEN sample AND split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 AS used FROM samples),
long AS (SELECT 'factor' AS feature, factor AS x FROM marked WHERE used UNION ALL SELECT 'fwd', fwd FROM marked WHERE used)"""

ORACLE_SQL = {
    "pushdown_scan": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13) AND o_orderdate BETWEEN '1996-01-01' AND '1999-12-31'",
    "market_inner_merge": _with(PANEL) + "SELECT stock_code, date, px, volume FROM panel WHERE stock_code % 3 <> 0 AND date BETWEEN DATE '1997-06-01' - 400 AND DATE '1998-06-30'",
    "calendar_month_end": "SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS month_end, count(*) AS days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) GROUP BY 1",
    "market_store": _with(PANEL) + "SELECT stock_code, date, px, volume, lag(px) OVER (PARTITION BY stock_code ORDER BY date) AS before FROM panel WHERE stock_code % 3 <> 0 AND date BETWEEN DATE '1997-06-01' - 400 AND DATE '1998-06-30'",
    "suspend_anti": _with(STATUS) + "SELECT user_id AS code, CAST(ts AS DATE) AS date, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.code = e.user_id AND s.date = CAST(e.ts AS DATE) AND s.if_suspend = 1)",
    "interval_anti_st": _with(INTERVALS, DAYS) + f"SELECT code, date FROM days d WHERE NOT {_IN.format(t='intervals')}",
    "interval_semi_members": _with(INTERVALS, DAYS) + f"SELECT code, date FROM days d WHERE {_IN.format(t='intervals')}",
    "universe_all_dates": _with(INTERVALS, DAYS) + f"SELECT code, date FROM days d WHERE NOT {_IN.format(t='(SELECT * FROM intervals WHERE code % 2 = 0)')} AND {_IN.format(t='(SELECT * FROM intervals WHERE code % 3 <> 0)')}",
    "listed_universe": _with(INTERVALS, DAYS, "f AS (SELECT *, coalesce(CASE WHEN code % 4 = 0 THEN DATE '1996-02-29' END, min(date) OVER (PARTITION BY code)) AS list_date FROM days)", f"g AS (SELECT *, CAST(list_date + INTERVAL 1 YEAR AS DATE) AS eligible_from, {_IN.format(t='intervals')} AS is_st FROM f d)")
    + "SELECT code, date, list_date, eligible_from, is_st, date >= eligible_from AND NOT is_st AS eligible_signal FROM g",
    "entry_tradability": _with(STATUS) + """SELECT e.event_id, CAST(coalesce(s.if_suspend, 0) AS BIGINT) AS entry_suspend, CAST(coalesce(s.limit_flag, 0) AS BIGINT) AS entry_limit, coalesce(s.if_suspend, 0) <> 1 AND coalesce(s.limit_flag, 0) <> 1 AS tradable
 FROM events e LEFT JOIN status s ON s.code = e.user_id AND s.date = CAST(e.ts AS DATE) + 1""",
    "factor_panel_clean": _with(PANEL, PREDICTIONS, "k AS (SELECT *, count(*) OVER (PARTITION BY model, date) AS n FROM predictions WHERE stock_code % 13 <> 0)") + "SELECT model, stock_code, date, prediction, label FROM k WHERE n >= 90",
    "price_volume_features": _with(BARS) + "SELECT stock_code, date, " + ", ".join(f"round(CASE WHEN {c} > 0 AND prev_close > 0 THEN ln({c}) - ln(prev_close) END, 6) + 0.0 AS f_{c}" for c in ("open", "high", "low", "close")) + ", " + ", ".join(f"round(CASE WHEN {c} >= 0 THEN ln(1 + {c}) END, 6) + 0.0 AS f_{c}" for c in ("volume", "turnover")) + " FROM bars",
    "adj_vwap": _with(BARS, _VWAP) + "SELECT stock_code, date, checked, passed, round(vwap, 5) + 0.0 AS vwap FROM v4",
    "vwap_diagnostics": _with(BARS, _VWAP) + "SELECT CAST(sum(CASE WHEN checked THEN 1 ELSE 0 END) AS BIGINT) AS checked, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed, round(avg(CASE WHEN checked THEN CASE WHEN passed THEN 1.0::DOUBLE ELSE 0 END END), 7) + 0.0 AS fraction, round(median(vwap / close_forward), 6) + 0.0 AS median_ratio FROM v4",
    "forward_labels": _with(PANEL, CALENDAR, _KEPT, _LABELS) + "SELECT stock_code, date, entry_date, exit_date, round(label, 6) + 0.0 AS label FROM labelled",
    "window_index": _with(PANEL, CALENDAR, _KEPT, _WINDOWS.format(t="kept")) + "SELECT stock_code, date, row_end - 5 AS row_start, row_end, coalesce(gap = 5, false) AS window_valid FROM windows",
    "split_assign": _with(PANEL, CALENDAR, _KEPT, _LABELS, _SPLIT) + "SELECT stock_code, date, split FROM split",
    "quality_summary": _with(PANEL, CALENDAR, _KEPT, _LABELS, _SPLIT) + "SELECT split, min(date) AS first_date, max(date) AS last_date, count(*) AS rows, CAST(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_labels, round(avg(CASE WHEN label IS NULL THEN 1.0::DOUBLE ELSE 0 END), 7) + 0.0 AS missing_rate FROM split GROUP BY 1",
    "rows_used": _with(PANEL) + "SELECT stock_code, date, coalesce(max(CASE WHEN stock_code % 5 = month(date) % 5 THEN 1 ELSE 0 END) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1, false) AS used FROM panel",
    "fit_preprocessor": _with(PANEL, _FIT) + "SELECT feature, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM fitted",
    "transform_features": _with(PANEL, _FIT, "f AS (SELECT * FROM fitted WHERE feature = 'factor')", "p AS (SELECT * FROM fitted WHERE feature = 'px')")
    + "SELECT stock_code, date, round((least(greatest(factor, f.low), f.high) - f.mean) / f.std, 5) + 0.0 AS factor, round((least(greatest(px, p.low), p.high) - p.mean) / p.std, 5) + 0.0 AS px FROM panel, f, p",
    "window_tensor_rows": _with(PANEL, CALENDAR, _WINDOWS.format(t="panel"), "rows AS (SELECT w.*, p.factor, p.fwd FROM windows w JOIN panel p ON p.stock_code = w.stock_code AND p.date = w.date)")
    + "SELECT w.stock_code, w.date, r.row_end - w.row_end + 5 AS step, r.factor, r.fwd FROM windows w JOIN rows r ON r.stock_code = w.stock_code AND r.row_end BETWEEN w.row_end - 5 AND w.row_end WHERE w.gap = 5",
    "learning_data": _with(PANEL, CALENDAR, "kept AS (SELECT * FROM panel)", _LABELS, _SPLIT, _WINDOWS.format(t="panel"), _SAMPLES, _FITTED, "f AS (SELECT * FROM fitted WHERE feature = 'factor')", "w AS (SELECT * FROM fitted WHERE feature = 'fwd')")
    + "SELECT stock_code, date, split, round(label, 6) + 0.0 AS label, round((least(greatest(factor, f.low), f.high) - f.mean) / f.std, 5) + 0.0 AS factor, round((least(greatest(fwd, w.low), w.high) - w.mean) / w.std, 5) + 0.0 AS fwd FROM marked, f, w WHERE sample",
    "deterministic_sample": _with(PANEL) + "SELECT stock_code, date FROM panel ORDER BY md5('7|' || stock_code || '|' || date) LIMIT 50",
}

ORACLE_SQL["window_block_rows"] = ORACLE_SQL["window_tensor_rows"]
