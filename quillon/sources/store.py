"""A bucketed market store: tables dealt by code and sorted by date, so that joins and windows by code need no exchange.

    store.open_session(spark)
    price, trade = (store.save(df, name, buckets=512) for ...)     # once
    price.join(trade, ["stock_code", "date"])                        # no exchange

Tables of one bucket count and one code column lie alike. A join on code and date
can use that only if Spark may take a subset of its keys as the partitioning, which
open_session says for the session; results don't change, only plans do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def open_session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")


def save(df: DataFrame, name: str, buckets: int = BUCKETS, code: str = "stock_code", date: str = "date", mode: str = "errorifexists") -> DataFrame:
    """df as table `name` in the warehouse, a file for each bucket; returns the table.

    Rows of a code lie in one bucket, so a bucket must hold the largest code. Null codes are a code of their own.
    """
    df.repartition(buckets, F.col(code)).write.mode(mode).bucketBy(buckets, code).sortBy(code, date).format("parquet").saveAsTable(name)
    return read(df.sparkSession, name)


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def merged(price: DataFrame, trade: DataFrame, start: str, end: str, look_back: int, keys: tuple[str, str] = ("stock_code", "date")) -> DataFrame:
    """Price and trade rows that both have, from look_back days before start; a sort-merge join, which keeps the buckets."""
    within = F.col(keys[1]).between(F.date_sub(F.to_date(F.lit(start)), look_back), F.to_date(F.lit(end)))
    return price.where(within).hint("merge").join(trade.where(within), list(keys), "inner")
