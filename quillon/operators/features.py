"""Features, forward labels, gap-free windows and the preparation of learning data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import clean
from .quantiles import exact_quantiles


def build_features(df: DataFrame, prices: Sequence[str] = ("open", "high", "low", "close"), base: str = "prev_close", amounts: Sequence[str] = ("volume", "turnover")) -> DataFrame:
    """ln(price / base) for four prices and ln(1 + amount) for two amounts; what isn't positive has none."""
    if len(prices) != 4 or len(amounts) != 2:
        raise ValueError("four prices and two amounts are needed")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    out = {f"f_{p}": clean(F.ln(positive(p)) - F.ln(positive(base))) for p in prices}
    out |= {f"f_{a}": clean(F.log1p(F.when(F.col(a) >= 0, F.col(a).cast("double")))) for a in amounts}
    return df.withColumns(out)


def forward_adjusted_vwap(df: DataFrame, sanity_min: float = 0.5, sanity_max: float = 2.0, out: str = "vwap") -> DataFrame:
    """turnover / volume, adjusted by close_forward / close; checked and passed say whether it fits the day's range."""
    parts = ["turnover", "volume", "close", "close_forward", "low", "high"]
    whole = F.lit(True)
    for c in parts:
        whole = whole & F.coalesce(F.col(c) > 0, F.lit(False))
    raw = F.when(whole, F.col("turnover") / F.col("volume"))
    passed = raw.between(F.col("low") * sanity_min, F.col("high") * sanity_max) & (raw / F.col("close")).between(sanity_min, sanity_max)
    return df.withColumn("checked", whole).withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn(out, F.when(passed, raw * F.col("close_forward") / F.col("close")))


def vwap_diagnostics(df: DataFrame) -> DataFrame:
    """checked, passed, fraction and the median ratio of vwap to the adjusted close."""
    ratio = F.col("vwap") / F.when(F.col("close_forward") > 0, F.col("close_forward"))
    rows = df.select(F.lit(1).alias("_all"), "checked", "passed", ratio.alias("_ratio"))
    counts = rows.groupBy("_all").agg(
        F.sum(F.col("checked").cast("long")).alias("checked"),
        F.sum(F.col("passed").cast("long")).alias("passed"),
        F.try_divide(F.sum(F.col("passed").cast("double")), F.sum(F.col("checked").cast("double"))).alias("fraction"),
    )
    median = exact_quantiles(rows.where("_ratio IS NOT NULL"), "_all", "_ratio", [0.5]).select("_all", F.col("q0").alias("median_ratio"))
    return counts.join(median, "_all", "left").drop("_all")


def assert_vwap(df: DataFrame, min_fraction: float = 0.95) -> None:
    row = vwap_diagnostics(df).first()
    if row is None or not row.checked or row.fraction < min_fraction:
        raise ValueError(f"only {(row and row.passed) or 0} of {(row and row.checked) or 0} rows have a plausible vwap")


def forward_labels(df: DataFrame, calendar: DataFrame, price: str = "vwap", entry_offset: int = 1, exit_offset: int = 4, code: str = "stock_code", out: str = "label") -> DataFrame:
    """Adds entry_date, exit_date and the return between them, by market dates, not by the code's own next rows.

    A date outside the calendar is an error; a missing price gives a missing label with its dates kept.
    """
    cal = calendar.select("date", "trade_index")
    if df.select("date").distinct().join(cal, "date", "left_anti").take(1):
        raise ValueError("a date isn't in the calendar")
    at = lambda name, offset: cal.select((F.col("trade_index") - offset).alias("trade_index"), F.col("date").alias(name))
    rows = df.join((cal), "date").join((at("entry_date", entry_offset)), "trade_index", "left").join((at("exit_date", exit_offset)), "trade_index", "left")
    own = df.select(F.col(code).alias("_c"), F.col("date").alias("_d"), F.when(F.col(price) > 0, F.col(price)).alias("_p"))
    for name in ("entry", "exit"):
        side = own.withColumnsRenamed({"_c": f"_c{name}", "_d": f"_d{name}", "_p": f"_p{name}"})
        rows = rows.join(side, (F.col(code) == F.col(f"_c{name}")) & (F.col(f"{name}_date") == F.col(f"_d{name}")), "left")
    return rows.withColumn(out, F.col("_pexit") / F.col("_pentry") - 1).drop("_centry", "_dentry", "_pentry", "_cexit", "_dexit", "_pexit")


def window_index(df: DataFrame, calendar: DataFrame, features: Sequence[str], length: int, code: str = "stock_code") -> DataFrame:
    """Rows whose features are all finite, with trade_index, row_start, row_end (within the code) and window_valid:
    whether the last `length` rows are consecutive market dates."""
    whole = F.lit(True)
    for f in features:
        whole = whole & clean(F.col(f)).isNotNull()
    rows = df.where(whole).join((calendar.select("date", "trade_index")), "date")
    own = Window.partitionBy(code).orderBy("date")
    rows = rows.withColumn("row_end", F.row_number().over(own).cast("long")).withColumn("row_start", F.col("row_end") - length + 1)
    gap = F.col("trade_index") - F.lag("trade_index", length - 1).over(own)
    return rows.withColumn("window_valid", F.coalesce(gap == length - 1, F.lit(False)))


@dataclass(frozen=True)
class Segment:
    name: str
    start: Date
    end: Date


def assign_splits(df: DataFrame, segments: Sequence[Segment], dates: Sequence[str] = ("date", "entry_date", "exit_date"), out: str = "split") -> DataFrame:
    """The segment that holds all dates of a sample, else null; segments must not overlap."""
    ordered = sorted(segments, key=lambda s: s.start)
    if any(s.end < s.start for s in ordered) or any(b.start <= a.end for a, b in zip(ordered, ordered[1:])):
        raise ValueError("segments overlap or end before they start")
    split = F.lit(None).cast("string")
    for s in ordered:
        inside = F.lit(True)
        for d in dates:
            inside = inside & F.col(d).between(F.lit(s.start), F.lit(s.end))
        split = F.when(inside, s.name).otherwise(split)
    return df.withColumn(out, split)


def rows_used(df: DataFrame, length: int, window_end: str, code: str = "stock_code", out: str = "used") -> DataFrame:
    """Whether a row lies in the window of `length` rows that ends at any row where window_end holds."""
    ahead = Window.partitionBy(code).orderBy("date").rowsBetween(0, length - 1)
    return df.withColumn(out, F.coalesce(F.max(F.col(window_end).cast("int")).over(ahead) == 1, F.lit(False)))


def fit_preprocessor(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99, eps: float = 1e-12) -> DataFrame:
    """feature, low, high, mean, std: clipping quantiles and, after clipping, mean and population deviation (1 if too small)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "x").where("x IS NOT NULL")
    cut = exact_quantiles(long, "feature", "x", [lower, upper]).select("feature", F.col("q0").alias("low"), F.col("q1").alias("high"))
    clipped = long.join(cut, "feature").withColumn("x", F.least(F.greatest("x", "low"), F.col("high")))
    out = clipped.groupBy("feature", "low", "high").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") <= eps, 1.0).otherwise(F.col("std")))


def transform_features(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(clip(x) - mean) / std with fitted parameters: a row for each feature, read once."""
    params = {r.feature: r for r in fitted.collect()}
    out = {}
    for c in columns:
        p = params[c]
        out[c] = F.when(F.col(c).isNotNull(), (F.least(F.greatest(F.col(c).cast("double"), F.lit(p.low)), F.lit(p.high)) - p.mean) / p.std)
    return df.withColumns(out)


def window_tensor(df: DataFrame, columns: Sequence[str], length: int, code: str = "stock_code", out: str = "window") -> DataFrame:
    """Valid windows as array<array<double>> of length x features."""
    own = Window.partitionBy(code).orderBy("date").rowsBetween(-(length - 1), 0)
    made = df.withColumn(out, F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(own))
    return made.where("window_valid")


def split_quality(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Dates, rows and missing labels of each split."""
    missing = F.sum(F.col(label).isNull().cast("long"))
    return df.groupBy(split).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("rows"), missing.alias("missing_labels"), (missing / F.count(F.lit(1))).alias("missing_rate"))


@dataclass
class LearningData:
    samples: DataFrame
    features: DataFrame
    preprocessor: DataFrame
    quality: DataFrame

    def split(self, name: str) -> DataFrame:
        return self.samples.where(F.col("split") == name)


def prepare_learning_data(panel: DataFrame, calendar: DataFrame, segments: Sequence[Segment], columns: Sequence[str], length: int, label_required: Sequence[str], label_optional: Sequence[str] = (), price: str = "vwap", entry_offset: int = 1, exit_offset: int = 4, universe: DataFrame | None = None, code: str = "stock_code") -> LearningData:
    """Windows with labels and splits; the preprocessor sees only rows that training windows cover.

    Every segment is declared as one that needs labels or one that doesn't; `train` must be among them.
    """
    declared = [*label_required, *label_optional]
    if sorted(declared) != sorted(s.name for s in segments) or len(set(declared)) != len(declared) or "train" not in declared:
        raise ValueError("each segment must be declared once, and train must be one")
    windows = window_index(panel, calendar, columns, length, code)
    labels = forward_labels(panel, calendar, price, entry_offset, exit_offset, code).select(code, "date", "entry_date", "exit_date", "label")
    rows = assign_splits(windows.join(labels, [code, "date"], "left"), segments)
    rows = rows.join(universe.select(code, "date", "eligible_signal"), [code, "date"], "left") if universe is not None else rows.withColumn("eligible_signal", F.lit(True))
    keep = F.col("window_valid") & F.col("split").isNotNull() & F.coalesce("eligible_signal", F.lit(False)) & (F.col("label").isNotNull() | F.col("split").isin(list(label_optional)))
    rows = rows.withColumn("sample", F.coalesce(keep, F.lit(False)))
    marked = rows_used(rows.withColumn("_train", F.col("sample") & (F.col("split") == "train")), length, "_train", code)
    fitted = fit_preprocessor(marked.where("used"), columns)
    features = transform_features(marked.drop("_train", "used"), fitted, columns)
    samples = features.where("sample")
    return LearningData(samples, features, fitted, split_quality(samples))
