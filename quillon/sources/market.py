"""Readers of market tables: a Parquet file for each dataset under one root.

Projection and predicates are left to Catalyst: select and filter on the returned
frames reach the scan. Dates are cast once, at the boundary.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import require_columns

CONFIG = ".quillon.json"
DEFAULT_ROOT = "~/local_data"
LOOK_BACK_DAYS = 400


def data_root(start: str | Path = ".") -> str:
    """data_root of the nearest configuration file at or above start; the default where it is absent or empty there."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        path = folder / CONFIG
        if not path.exists():
            continue
        try:
            text = path.read_text(encoding="utf-8")
        except OSError as e:
            raise RuntimeError(f"{path} can't be read") from e
        try:
            found = json.loads(text)
        except ValueError as e:
            raise ValueError(f"{path} isn't JSON") from e
        if not isinstance(found, dict):
            raise ValueError(f"{path} must hold an object")
        root = found.get("data_root", "")
        if not isinstance(root, str):
            raise ValueError(f"data_root in {path} must be a string")
        if root:
            return str(Path(root).expanduser())
        break
    return str(Path(DEFAULT_ROOT).expanduser())


def load(spark: SparkSession, root: str, dataset: str, columns: Sequence[str] | None = None, dates: Sequence[str] = ("date",), codes: Sequence[str] | None = None, start: str | None = None, end: str | None = None, code_col: str = "stock_code", date_col: str = "date") -> DataFrame:
    """A dataset, projected and restricted to codes and an inclusive range of dates."""
    df = spark.read.parquet(f"{root}/{dataset}.parquet")
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*columns)
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start).cast(df.schema[date_col].dataType))
    if end is not None:
        df = df.where(F.col(date_col) <= F.lit(end).cast(df.schema[date_col].dataType))
    if codes is not None:
        df = df.where(F.col(code_col).isin(list(codes)))
    return df.withColumns({c: F.to_date(c) for c in dates if c in df.columns})


def stock_price(spark, root, columns=None):
    return load(spark, root, "stock_price", columns)


def stock_price_forward(spark, root, columns=None, codes=None, start=None, end=None):
    return load(spark, root, "stock_price_forward", columns, codes=codes, start=start, end=end)


def stock_trade(spark, root, columns=None):
    return load(spark, root, "stock_trade", columns)


def suspend_status(spark, root, codes=None, start=None):
    return load(spark, root, "stock_suspend", codes=codes, start=start)


suspend = suspend_status


def limit_status(spark, root, codes=None, start=None):
    return load(spark, root, "stock_limit", codes=codes, start=start)


def st_intervals(spark, root):
    return load(spark, root, "stock_st", dates=("implement_date", "remove_date"))


def index_components(spark, root, index_code):
    return load(spark, root, "index_components", dates=("in_date", "out_date")).where(F.col("index_code") == index_code)


def industry(spark, root, standard: int = 37):
    """One industry for each stock: the alphabetically first, should there be several."""
    rows = load(spark, root, "stock_industry", dates=()).where(F.col("standard_code") == standard)
    return rows.groupBy("stock_code").agg(F.min("first_industry_name").alias("first_industry_name"))


def trade_calendar(spark, root, start=None, end=None):
    return load(spark, root, "calendar", start=start, end=end).where("IfTradingDay = 1").orderBy("date")


def month_end_days(spark, root, start=None, end=None):
    return load(spark, root, "calendar", start=start, end=end).where("IfMonthEnd = 1").select("date").orderBy("date")


def market_data(price: DataFrame, trade: DataFrame, start: str, end: str, keys: Sequence[str] = ("stock_code", "date"), look_back: int = LOOK_BACK_DAYS) -> DataFrame:
    """Price and trade rows that both have, from look_back days before start, so that windows can fill."""
    within = F.col("date").between(F.date_sub(F.to_date(F.lit(start)), look_back), F.to_date(F.lit(end)))
    return price.where(within).join(trade.where(within), list(keys), "inner")


def pages_of_text(df: DataFrame, text_col: str, keys: Sequence[str], mark: str = "\f") -> DataFrame:
    """keys, page (from 1), page_text: a paged text as rows; the last empty page of a trailing mark is none."""
    parts = F.split(F.col(text_col), mark, -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return df.select(*keys, F.posexplode(kept).alias("_p", "page_text")).select(*keys, (F.col("_p") + 1).alias("page"), "page_text")


def html_tables(df: DataFrame, html_col: str, keys: Sequence[str]) -> DataFrame:
    """keys, table_no, row_no, cells: the rows of HTML tables."""
    tables = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    rows = df.select(*keys, F.posexplode(tables).alias("table_no", "t")).select(*keys, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return rows.select(*keys, "table_no", "row_no", cells.alias("cells"))


def markdown_table(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of html_tables as Markdown lines, pipes escaped."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    return rows.select(*keys, "table_no", "row_no", line.alias("line"))
