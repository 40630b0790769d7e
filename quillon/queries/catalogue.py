"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["cross_section", "performance", "data", "portfolios", "verification", "reports", "readers", "documents"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly group and long/short returns of the factor, with the date's rank IC."""
    from . import cross_section, performance

    returns = performance.quantile_backtest(spark, sf_dir)
    return returns.join(cross_section.rank_ic(spark, sf_dir), "date", "left")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
