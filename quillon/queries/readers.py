"""Queries of the readers of market tables, over a root written from the test tables, with SQL."""

from __future__ import annotations

from ..sources import market
from ..sources import synthetic as syn
from ..sources.synthetic import ATTRIBUTES, BARS, CALENDAR_DAYS, INTERVALS, STATUS
from .cross_section import _with

START, END = "1995-03-01", "1998-10-31"
EVENTS_START = "2024-01-10"


def read_prices(spark, d):
    return market.stock_price(spark, syn.market_root(spark, d, "stock_price"), ["stock_code", "date", "open", "close"])


def read_forward_prices(spark, d):
    root = syn.market_root(spark, d, "stock_price_forward")
    return market.stock_price_forward(spark, root, ["stock_code", "date", "close"], codes=[1, 2, 3, 5, 8], start=START, end=END)


def read_trades(spark, d):
    return market.stock_trade(spark, syn.market_root(spark, d, "stock_trade"), ["stock_code", "date", "volume", "turnover"])


def read_suspended(spark, d):
    return market.suspend(spark, syn.market_root(spark, d, "stock_suspend"), codes=[1, 2, 3, 5, 8, 13, 21], start=EVENTS_START)


def read_limits(spark, d):
    return market.limit_status(spark, syn.market_root(spark, d, "stock_limit"), start=EVENTS_START)


def read_st(spark, d):
    return market.st_intervals(spark, syn.market_root(spark, d, "stock_st"))


def read_members(spark, d):
    return market.index_components(spark, syn.market_root(spark, d, "index_components"), "000300").select("stock_code", "in_date", "out_date")


def read_industry(spark, d):
    return market.industry(spark, syn.market_root(spark, d, "stock_industry"))


def read_calendar(spark, d):
    return market.trade_calendar(spark, syn.market_root(spark, d, "calendar"), START, END).select("date")


def read_month_ends(spark, d):
    return market.month_end_days(spark, syn.market_root(spark, d, "calendar"), START, END)


QUERIES = {f.__name__: f for f in (read_prices, read_forward_prices, read_trades, read_suspended, read_limits, read_st, read_members, read_industry, read_calendar, read_month_ends)}

ORACLE_SQL = {
    "read_prices": _with(BARS) + "SELECT stock_code, date, open, close FROM bars",
    "read_forward_prices": _with(BARS) + f"SELECT stock_code, date, close_forward AS close FROM bars WHERE stock_code IN (1, 2, 3, 5, 8) AND date BETWEEN '{START}' AND '{END}'",
    "read_trades": _with(BARS) + "SELECT stock_code, date, volume, turnover FROM bars",
    "read_suspended": _with(STATUS) + f"SELECT code AS stock_code, date, if_suspend FROM status WHERE code IN (1, 2, 3, 5, 8, 13, 21) AND date >= '{EVENTS_START}'",
    "read_limits": _with(STATUS) + f"SELECT code AS stock_code, date, limit_flag FROM status WHERE date >= '{EVENTS_START}'",
    "read_st": _with(INTERVALS) + "SELECT code AS stock_code, start AS implement_date, stop AS remove_date FROM intervals",
    "read_members": _with(INTERVALS) + "SELECT code AS stock_code, start AS in_date, stop AS out_date FROM intervals WHERE code % 2 = 0",
    "read_industry": _with(ATTRIBUTES) + "SELECT stock_code, CASE WHEN stock_code % 5 = 0 THEN 'agriculture' ELSE 'sector ' || industry END AS first_industry_name FROM attributes WHERE industry IS NOT NULL OR stock_code % 5 = 0",
    "read_calendar": _with(CALENDAR_DAYS) + f"SELECT date FROM calendar_days WHERE is_trading = 1 AND date BETWEEN '{START}' AND '{END}'",
    "read_month_ends": _with(CALENDAR_DAYS) + f"SELECT date FROM calendar_days WHERE is_month_end = 1 AND date BETWEEN '{START}' AND '{END}'",
}
