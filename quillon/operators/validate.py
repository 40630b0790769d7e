"""Checks of schema, keys and join cardinality. Those that must look at rows stop at the first offender."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.statistics import clean


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique_keys(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    if found := duplicate_keys(df, keys).take(1):
        raise ValueError(f"{name} repeats {found[0].asDict()}")


def join_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose right side must have each key once."""
    assert_unique_keys(right, keys, "the right side")
    return left.join(right, list(keys), how)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    assert_unique_keys(left, keys, "the left side")
    return join_to_one(left, right, keys, how)


def prepare_factor_panel(df: DataFrame, min_cross_section: int, n_models: int | None = None) -> DataFrame:
    """Predictions with normal dates and finite numbers: null keys are an error, missing predictions go, missing labels
    stay, and dates with a cross-section below the minimum go."""
    require_columns(df, ["model", "stock_code", "date", "prediction", "label"])
    rows = df.withColumn("date", F.to_date("date"))
    if rows.where("model IS NULL OR stock_code IS NULL OR date IS NULL").take(1):
        raise ValueError("a key is null")
    assert_unique_keys(rows, ["model", "stock_code", "date"], "predictions")
    if n_models is not None and (found := rows.select("model").distinct().count()) != n_models:
        raise ValueError(f"{n_models} models expected, {found} found")
    rows = rows.withColumn("prediction", clean(F.expr("try_cast(prediction AS double)"))).withColumn("label", clean(F.expr("try_cast(label AS double)"))).where("prediction IS NOT NULL")
    size = F.count(F.lit(1)).over(Window.partitionBy("model", "date"))
    return rows.withColumn("_n", size).where(F.col("_n") >= min_cross_section).drop("_n")


def write_checked(df: DataFrame, path: str, keys: Sequence[str], least_rows: int = 0) -> DataFrame:
    """df as Parquet at path, a new folder, if no key is null or repeated and there are least_rows rows; returns the table.

    The checks are counted by the job that writes, beside the place; only a table that passes is renamed to it,
    otherwise nothing is left and the counts are in the error.
    """
    require_columns(df, keys)
    spark, seen = df.sparkSession, Observation()
    null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    rows = df.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(null).alias("null_keys"), F.count_if(~null & (F.col("_times") > 1)).alias("repeated"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} is there already")
    watched.drop("_times").write.parquet(part.toString())
    found = seen.get
    if found["null_keys"] or found["repeated"] or found["rows"] < least_rows:
        fs.delete(part, True)
        raise ValueError(f"not written: {found}")
    if not fs.rename(part, target):
        raise OSError(f"{part.toString()} can't be renamed to {path}")
    return spark.read.schema(df.schema).parquet(path)


def deterministic_sample(df: DataFrame, keys: Sequence[str], limit: int, seed: int = 0) -> DataFrame:
    """limit rows for display, chosen by a hash of their keys."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_k", key).orderBy("_k", *keys).limit(limit).drop("_k")


@dataclass(frozen=True)
class PortfolioSettings:
    """Invariants of a multi-path portfolio backtest."""

    n_groups: int = 5
    interval: int = 3
    entry_offset: int = 1
    exit_offset: int = 4
    path_offsets: tuple[int, ...] = (0, 1, 2)
    min_cross_section: int = 10
    initial_capital: float = 1e6
    sell_fee: float = 0.001
    share_epsilon: float = 1e-9
    periods_per_year: int = 12

    def validate(self) -> PortfolioSettings:
        rules = {
            "n_groups must be 2 or more": self.n_groups >= 2,
            "interval must be positive": self.interval >= 1,
            "entry_offset must be 1 or more": self.entry_offset >= 1,
            "exit_offset must come after entry_offset": self.exit_offset > self.entry_offset,
            "exit_offset - entry_offset must equal interval": self.exit_offset - self.entry_offset == self.interval,
            "path_offsets must be 0..interval-1": tuple(self.path_offsets) == tuple(range(self.interval)),
            "min_cross_section must reach n_groups": self.min_cross_section >= self.n_groups,
            "initial_capital must be positive": self.initial_capital > 0,
            "sell_fee must be in [0, 1)": 0 <= self.sell_fee < 1,
            "share_epsilon must be positive": self.share_epsilon > 0,
            "periods_per_year must be positive": self.periods_per_year > 0,
        }
        broken = [text for text, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))
        return self
