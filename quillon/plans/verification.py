"""Tolerance decisions on reproduced metrics, as column expressions, and checks of whole documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import never_free

#: Conclusions of an out-of-sample check, and attributions that explain a failed metric.
CONCLUSIONS = ("continues", "decayed", "failed", "insufficient_data")
ATTRIBUTIONS = ("accepted", "assumption_linked")
SPEC = "max_rel_dev double, abs_eps double, require_same_sign boolean, order_of_magnitude_only boolean, direction_only boolean"


def lookup_tolerance(metrics: DataFrame, standards: DataFrame, user_max: float | None = None) -> DataFrame:
    """Adds the spec columns: by layer for layered metrics, else by tolerance_key or key, else the default.

    standards: type, layer, key and the spec. user_max in (0, 1] takes the place of every max_rel_dev.
    """
    if user_max is not None and not 0 < user_max <= 1:
        raise ValueError("a tolerance lies in (0, 1]")
    names = ["max_rel_dev", "abs_eps", "require_same_sign", "order_of_magnitude_only", "direction_only"]
    spec = F.struct(*[F.col(n).alias(n) for n in names]).alias("_spec")
    by_layer = standards.where("layer IS NOT NULL").select(F.col("type").alias("_t1"), F.col("layer").alias("_l"), spec)
    by_key = standards.where("layer IS NULL AND key <> 'default'").select(F.col("type").alias("_t2"), F.col("key").alias("_k"), spec)
    default = standards.where("layer IS NULL AND key = 'default'").select(F.col("type").alias("_t3"), spec)
    rows = metrics.join(by_layer, (F.col("type") == F.col("_t1")) & (F.col("layer") == F.col("_l")), "left").withColumnRenamed("_spec", "_s1")
    rows = rows.join(by_key, (F.col("type") == F.col("_t2")) & (F.coalesce("tolerance_key", "key") == F.col("_k")), "left").withColumnRenamed("_spec", "_s2")
    rows = rows.join(default, F.col("type") == F.col("_t3"), "left").withColumnRenamed("_spec", "_s3")
    chosen = F.coalesce("_s1", "_s2", "_s3")
    rows = rows.withColumns({n: chosen[n] for n in names})
    if user_max is not None:
        rows = rows.withColumn("max_rel_dev", F.when(F.col("max_rel_dev").isNotNull(), F.lit(user_max)))
    return rows.drop("_t1", "_l", "_t2", "_k", "_t3", "_s1", "_s2", "_s3")


def relative_deviation(report: Column, made: Column) -> Column:
    return F.when(report != 0, F.abs(made - report) / F.abs(F.when(report != 0, report)))


def decide(metrics: DataFrame) -> DataFrame:
    """Adds rel_dev, passed (null: can't be decided) and reason. Stored verdicts are never read.

    The first rule that applies decides: a lowered verification level, values that aren't numbers,
    direction only, both near zero, opposite signs, order of magnitude, a zero in the report, relative deviation.
    """
    a, b = F.expr("try_cast(report_value AS double)"), F.expr("try_cast(reproduced_value AS double)")
    finite = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    level, linked = F.coalesce("verification_level", F.lit("full")), F.coalesce(F.col("attribution_status") == "assumption_linked", F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    product = a * b
    same = (product > 0) | ((a == 0) & (b == 0))
    ratio = F.when(a != 0, F.abs(b / F.when(a != 0, a)))
    magnitude = F.coalesce(ratio.between(0.1, 10.0), (a == 0) & (b == 0))
    dev = relative_deviation(a, b)
    near = F.col("abs_eps").isNotNull() & (F.abs(a) < F.col("abs_eps"))
    cases = [
        ((level != "full") & ~linked, F.lit(False), "level_without_assumption"),
        (level == "unverifiable", F.lit(None).cast("boolean"), "unverifiable"),
        (~level.isin("full", "directional", "magnitude"), F.lit(False), "unknown_level"),
        (~finite, F.lit(False), "not_numeric"),
        (level == "directional", same, "directional"),
        (level == "magnitude", magnitude, "magnitude"),
        (flag("direction_only"), product >= 0, "direction_only"),
        (near, F.abs(b - a) <= F.col("abs_eps"), "near_zero"),
        (flag("require_same_sign") & (product < 0), F.lit(False), "opposite_sign"),
        (flag("order_of_magnitude_only"), magnitude, "order_of_magnitude"),
        (a == 0, b == 0, "zero_report"),
        (F.col("max_rel_dev").isNull(), F.lit(None).cast("boolean"), "no_tolerance"),
    ]
    passed, reason = dev <= F.col("max_rel_dev"), F.lit("relative")
    for when, value, name in reversed(cases):
        hit = F.coalesce(when, F.lit(False))
        passed, reason = F.when(hit, value).otherwise(passed), F.when(hit, F.lit(name)).otherwise(reason)
    return metrics.withColumns({"rel_dev": dev, "passed": passed, "reason": reason})


def overall(decided: DataFrame, by: Iterable[str] = ("type",)) -> DataFrame:
    known = F.col("passed").isNotNull()
    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(F.col("passed").cast("long"), F.lit(0))).alias("passed_count"), F.sum((~known).cast("long")).alias("undecided"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed")
    )


def attribution_gaps(decided: DataFrame) -> DataFrame:
    """Failed metrics that nothing explains."""
    return decided.where(~F.col("passed") & ~F.coalesce(F.col("attribution_status").isin(*ATTRIBUTIONS), F.lit(False)))


def out_of_sample_verdict(df: DataFrame, inside: str = "sharpe_in", outside: str = "sharpe_out", days: str = "days", least_days: int = 60) -> DataFrame:
    a, b = F.col(inside), F.col(outside)
    verdict = F.when(F.col(days) < least_days, "insufficient_data").when(a * b < 0, "failed").when(F.abs(b) >= 0.5 * F.abs(a), "continues").otherwise("decayed")
    return df.withColumn("conclusion", verdict)


def check_out_of_sample(df: DataFrame) -> DataFrame:
    """Problems of out-of-sample documents: in_sample_end, oos_start, oos_end, oos_days, conclusion, warning."""
    order = (F.to_date("oos_start") > F.to_date("in_sample_end")) & (F.to_date("oos_end") >= F.to_date("oos_start"))
    rules = {
        "missing_field": F.col("in_sample_end").isNull() | F.col("oos_start").isNull() | F.col("oos_end").isNull() | F.col("oos_days").isNull(),
        "dates_out_of_order": ~order,
        "unknown_conclusion": ~F.coalesce(F.col("conclusion").isin(*CONCLUSIONS), F.lit(False)),
        "short_without_warning": (F.col("oos_days") < 60) & (F.length(F.coalesce("warning", F.lit(""))) == 0),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("problems", found).withColumn("passed", F.size("problems") == 0)


def fresh(files: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """files: by, kind (source or output), path, modified. Whether all outputs are newer than the last source; caches don't count."""
    own = files.where(~F.col("path").rlike(r"(/__pycache__/|\.pyc$)"))
    newest, oldest = F.max(F.when(F.col("kind") == "source", F.col("modified"))), F.min(F.when(F.col("kind") == "output", F.col("modified")))
    return own.groupBy(*by).agg(newest.alias("newest_source"), oldest.alias("oldest_output"), F.coalesce(oldest > newest, F.lit(False)).alias("passed"))


def has_cycle(milestones: DataFrame) -> bool:
    """milestones: id, deps. Unknown ids don't count."""
    return bool(never_free(milestones).take(1))


def missing_items(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present, keys, "left_anti")


def gate(rows: DataFrame) -> DataFrame:
    """rows: stage, check_id, passed. One verdict for each stage."""
    return rows.groupBy("stage").agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("verdict"), F.count(F.lit(1)).alias("checks"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check_id")))).alias("failed"))
