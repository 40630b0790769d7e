"""Queries of the cross-sectional operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statistics import student_t_two_sided
from ..operators import cross_section as xs
from ..sources import synthetic as syn
from ..sources.synthetic import ASSETS, ATTRIBUTES, PANEL, PREDICTIONS


def _r(c: str, digits: int = 7):
    """Rounded, without minus zero."""
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def attributed(spark: SparkSession, d: str) -> DataFrame:
    return syn.panel(spark, d).join(syn.attributes(spark, d), "stock_code", "left")


def winsorize_mad(spark, d):
    return xs.winsorize(syn.panel(spark, d), "factor", out="w").select("stock_code", "date", _r("w"))


def winsorize_std(spark, d):
    return xs.winsorize(syn.panel(spark, d), "factor", out="w", method="std").select("stock_code", "date", _r("w"))


def zscore(spark, d):
    return xs.standardize(syn.panel(spark, d), "factor", out="z").select("stock_code", "date", _r("z"))


def neutralize_fwl(spark, d):
    return xs.neutralize(attributed(spark, d), "factor", out="res").select("stock_code", "date", _r("res"))


def standardize_factor(spark, d):
    return xs.standardize_factor(attributed(spark, d), "factor", cap="market_cap", industry="industry").select("stock_code", "date", _r("factor_std", 6))


def pearson_ic(spark, d):
    return xs.ic_series(syn.panel(spark, d), method="pearson").select("date", _r("ic"), "n")


def rank_ic(spark, d):
    return xs.ic_series(syn.panel(spark, d)).select("date", _r("ic"), "n")


def ic_summary(spark, d):
    return xs.ic_summary(xs.ic_series(syn.panel(spark, d))).select(*[_r(c, 6) for c in ("ic_mean", "ic_std", "icir", "win_rate", "t_stat")], "n")


def qcut_groups(spark, d):
    return xs.quantile_groups(syn.panel(spark, d), n=5).select("stock_code", "date", F.col("group").cast("long").alias("grp"))


def desc_groups(spark, d):
    return xs.descending_groups(syn.predictions(spark, d), 10).select("model", "stock_code", "date", F.col("group").cast("long").alias("grp"))


def ols_slope_t(spark, d):
    return xs.ols_univariate(syn.panel(spark, d), "factor", "fwd", ["date"]).select("date", _r("alpha", 6), _r("beta", 6), _r("std_error", 6), _r("t_stat", 5), "n")


def ols_p_value(spark, d):
    fit = xs.ols_univariate(syn.panel(spark, d), "factor", "fwd", ["date"])
    fit = fit.withColumn("p", student_t_two_sided(F.col("t_stat"), (F.col("n") - 2).cast("double")))
    return fit.select("date", _r("t_stat", 5), _r("p", 8).alias("p_value"))


def model_corr_overall(spark, d):
    return xs.model_pairs(syn.predictions(spark, d)).select("left_model", "right_model", "n", _r("correlation"), "status")


def model_corr_daily(spark, d):
    return xs.model_pairs(syn.predictions(spark, d), by_date=True, method="spearman").select("left_model", "right_model", "date", "n", _r("correlation"), "status")


def correlation_matrix(spark, d):
    p = syn.predictions(spark, d)
    return xs.correlation_matrix(xs.model_pairs(p), p.select("model").distinct()).select("row", "col", _r("correlation"))


def correlation_range(spark, d):
    return xs.off_diagonal_range(correlation_matrix(spark, d))


def _asset_pairs(spark, d) -> DataFrame:
    a = syn.asset_returns(spark, d).withColumnsRenamed({"asset": "model", "ret": "prediction"}).withColumnRenamed("date", "date").withColumn("stock_code", F.lit(0))
    return xs.correlation_matrix(xs.model_pairs(a), a.select("model").distinct())


def frobenius(spark, d):
    return xs.frobenius_diversification(_asset_pairs(spark, d)).select(_r("distance", 5))


QUERIES = {f.__name__: f for f in (winsorize_mad, winsorize_std, zscore, neutralize_fwl, standardize_factor, pearson_ic, rank_ic, ic_summary, qcut_groups, desc_groups, ols_slope_t, ols_p_value, model_corr_overall, model_corr_daily, correlation_matrix, correlation_range, frobenius)}

_CLIP = """CASE WHEN {x} IS NOT NULL THEN CASE WHEN spread IS NULL THEN {x} ELSE least(greatest({x}, mid - 3 * spread), mid + 3 * spread) END END"""
_MAD = """mad AS (SELECT *, 1.4826::DOUBLE * median(abs(factor - mid)) OVER (PARTITION BY date) AS spread FROM (SELECT *, median(factor) OVER (PARTITION BY date) AS mid FROM {src}))"""
_NEUTRAL = """n1 AS (SELECT *, factor IS NOT NULL AND market_cap IS NOT NULL AS used FROM {src}),
n2 AS (SELECT *, CASE WHEN used THEN coalesce(industry, min(CASE WHEN used THEN industry END) OVER (PARTITION BY date), 0) END AS ind, CASE WHEN used THEN ln(greatest(market_cap, 1.0)) END AS lc, CASE WHEN used THEN factor END AS f FROM n1),
n3 AS (SELECT *, f - avg(f) OVER (PARTITION BY date, ind) AS fd, lc - avg(lc) OVER (PARTITION BY date, ind) AS xd FROM n2),
n4 AS (SELECT *, sum(fd * xd) OVER (PARTITION BY date) AS sxy, sum(xd * xd) OVER (PARTITION BY date) AS sxx, count(f) OVER (PARTITION BY date) AS nr, count(DISTINCT ind) OVER (PARTITION BY date) + 1 AS nc FROM n3),
neutral AS (SELECT stock_code, date, CASE WHEN nr <= nc THEN factor ELSE fd - xd * (CASE WHEN sxx = 0 THEN 0 ELSE coalesce(sxy / sxx, 0) END) END AS res FROM n4)"""
_PAIRS = """ranks AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0::DOUBLE AS y FROM panel WHERE factor IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, CASE WHEN count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS ic, count(*) AS n FROM ranks GROUP BY date)"""
_GROUPS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, stock_code) AS r, count(*) OVER (PARTITION BY date) AS m FROM panel WHERE factor IS NOT NULL),
edges AS (SELECT *, [k * (1.0::DOUBLE / 5) * 100.0::DOUBLE / 100.0::DOUBLE * (m - 1) FOR k IN [1, 2, 3, 4]] AS pos FROM ranked),
grouped AS (SELECT stock_code, date, factor, fwd, 1 + len([a FOR a IN pos IF r > CASE WHEN a - floor(a) < 0.5 THEN floor(a) + 1 + (least(floor(a) + 2, m) - floor(a) - 1) * (a - floor(a))
 ELSE least(floor(a) + 2, m) - (least(floor(a) + 2, m) - floor(a) - 1) * (1 - (a - floor(a))) END]) AS grp FROM edges)"""
_MODEL = """pairs AS (SELECT a.model AS left_model, b.model AS right_model, a.date, a.prediction AS x, b.prediction AS y FROM predictions a JOIN predictions b ON a.stock_code = b.stock_code AND a.date = b.date AND a.model < b.model)"""
_CORR = "CASE WHEN count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END"
_STATUS = "CASE WHEN count(*) < 5 THEN 'insufficient_common_samples' WHEN least(count(DISTINCT x), count(DISTINCT y)) < 2 THEN 'constant_prediction' ELSE 'valid' END"
_OVERALL = f"overall AS (SELECT left_model, right_model, count(*) AS n, round({_CORR}, 7) + 0.0 AS correlation, {_STATUS} AS status FROM pairs GROUP BY 1, 2)"
_MATRIX = "matrix AS (SELECT left_model AS row, right_model AS col, correlation FROM overall UNION ALL SELECT right_model, left_model, correlation FROM overall UNION ALL SELECT DISTINCT model, model, 1.0::DOUBLE FROM predictions)"

ORACLE_SQL = {
    "winsorize_mad": _with(PANEL, _MAD.format(src="panel")) + f"SELECT stock_code, date, round({_CLIP.format(x='factor')}, 7) + 0.0 AS w FROM mad",
    "winsorize_std": _with(PANEL, "s AS (SELECT *, avg(factor) OVER (PARTITION BY date) AS mid, stddev_samp(factor) OVER (PARTITION BY date) AS spread FROM panel)") + f"SELECT stock_code, date, round({_CLIP.format(x='factor')}, 7) + 0.0 AS w FROM s",
    "zscore": _with(PANEL, "s AS (SELECT *, avg(factor) OVER (PARTITION BY date) AS mid, stddev_samp(factor) OVER (PARTITION BY date) AS sd FROM panel)") + "SELECT stock_code, date, round(CASE WHEN sd = 0 THEN 0 ELSE (factor - mid) / sd END, 7) + 0.0 AS z FROM s",
    "neutralize_fwl": _with(PANEL, ATTRIBUTES, "src AS (SELECT p.*, industry, market_cap FROM panel p LEFT JOIN attributes a ON a.stock_code = p.stock_code)", _NEUTRAL.format(src="src")) + "SELECT stock_code, date, round(res, 7) + 0.0 AS res FROM neutral",
    "standardize_factor": _with(PANEL, ATTRIBUTES, _MAD.format(src="panel"), f"src AS (SELECT p.stock_code, p.date, industry, market_cap, {_CLIP.format(x='factor')} AS factor FROM mad p LEFT JOIN attributes a ON a.stock_code = p.stock_code)", _NEUTRAL.format(src="src"), "s AS (SELECT *, avg(res) OVER (PARTITION BY date) AS mid, stddev_samp(res) OVER (PARTITION BY date) AS sd FROM neutral)")
    + "SELECT stock_code, date, round(CASE WHEN sd = 0 THEN res * 0 ELSE (res - mid) / sd END, 6) + 0.0 AS factor_std FROM s",
    "pearson_ic": _with(PANEL, "v AS (SELECT date, factor AS x, fwd AS y FROM panel WHERE factor IS NOT NULL AND fwd IS NOT NULL)") + f"SELECT date, round({_CORR}, 7) + 0.0 AS ic, count(*) AS n FROM v GROUP BY date",
    "rank_ic": _with(PANEL, _PAIRS) + "SELECT date, round(ic, 7) + 0.0 AS ic, n FROM ic",
    "ic_summary": _with(PANEL, _PAIRS) + """SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic) * sqrt(12), 6) AS icir,
 round(avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) AS t_stat, count(ic) AS n FROM ic""",
    "qcut_groups": _with(PANEL, _GROUPS) + "SELECT stock_code, date, CAST(grp AS BIGINT) AS grp FROM grouped",
    "desc_groups": _with(PANEL, PREDICTIONS) + "SELECT model, stock_code, date, CAST(((row_number() OVER w - 1) * 10) // count(*) OVER (PARTITION BY model, date) + 1 AS BIGINT) AS grp FROM predictions WINDOW w AS (PARTITION BY model, date ORDER BY prediction DESC, stock_code)",
    "ols_slope_t": _with(PANEL, """f AS (SELECT date, count(*) AS n, avg(factor) AS mx, avg(fwd) AS my, regr_sxx(fwd, factor) AS sxx, regr_syy(fwd, factor) AS syy, regr_sxy(fwd, factor) AS sxy, min(factor) < max(factor) AS varies FROM panel WHERE factor IS NOT NULL AND fwd IS NOT NULL GROUP BY date),
b AS (SELECT *, CASE WHEN n >= 3 AND varies THEN sxy / sxx END AS beta FROM f), e AS (SELECT *, CASE WHEN n >= 3 AND varies THEN CASE WHEN (syy - beta * sxy) / (n - 2) <= 0 THEN 0 ELSE sqrt((syy - beta * sxy) / (n - 2) / sxx) END END AS se FROM b)""")
    + """SELECT d.date, round(my - beta * mx, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta, round(se, 6) + 0.0 AS std_error, round(CASE WHEN se > 0 THEN beta / se END, 5) + 0.0 AS t_stat, coalesce(n, 0) AS n FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN e ON e.date = d.date""",
    "ols_p_value": _with(PANEL, """f AS (SELECT date, count(*) AS n, regr_sxx(fwd, factor) AS sxx, regr_syy(fwd, factor) AS syy, regr_sxy(fwd, factor) AS sxy FROM panel WHERE factor IS NOT NULL AND fwd IS NOT NULL GROUP BY date HAVING count(*) >= 3 AND min(factor) < max(factor)),
e AS (SELECT date, n - 2 AS v, sxy / sxx / nullif(sqrt(greatest(0, (syy - sxy * sxy / sxx) / (n - 2)) / sxx), 0) AS t FROM f), u AS (SELECT *, atan(abs(t) / sqrt(v)) AS u FROM e),
s AS (SELECT *, list_sum([CASE WHEN v % 2 = 1 THEN exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos(u), 2 * j + 1) ELSE exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(cos(u), 2 * j) END FOR j IN range(0, CAST(floor(CASE WHEN v % 2 = 1 THEN v - 1 ELSE v END / 2) AS BIGINT))]) AS total FROM u)""")
    + """SELECT d.date, round(t, 5) + 0.0 AS t_stat, CASE WHEN t IS NOT NULL THEN round(greatest(0.0::DOUBLE, 1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (u + sin(u) * coalesce(total, 0)) ELSE sin(u) * total END), 8) + 0.0 END AS p_value FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN s ON s.date = d.date""",
    "model_corr_overall": _with(PANEL, PREDICTIONS, _MODEL, _OVERALL) + "SELECT * FROM overall",
    "model_corr_daily": _with(PANEL, PREDICTIONS, _MODEL, """rk AS (SELECT left_model, right_model, date, rank() OVER (PARTITION BY left_model, right_model, date ORDER BY x) + (count(*) OVER (PARTITION BY left_model, right_model, date, x) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (PARTITION BY left_model, right_model, date ORDER BY y) + (count(*) OVER (PARTITION BY left_model, right_model, date, y) - 1) / 2.0::DOUBLE AS y FROM pairs)""")
    + f"SELECT left_model, right_model, date, count(*) AS n, round({_CORR}, 7) + 0.0 AS correlation, {_STATUS} AS status FROM rk GROUP BY 1, 2, 3",
    "correlation_matrix": _with(PANEL, PREDICTIONS, _MODEL, _OVERALL, _MATRIX) + "SELECT * FROM matrix",
    "correlation_range": _with(PANEL, PREDICTIONS, _MODEL, _OVERALL, _MATRIX) + "SELECT min(correlation) AS least, max(correlation) AS most FROM matrix WHERE row <> col",
    "frobenius": _with(ASSETS, f"p AS (SELECT a.asset AS i, b.asset AS j, a.ret AS x, b.ret AS y FROM assets a JOIN assets b ON a.date = b.date AND a.asset < b.asset), c AS (SELECT i, j, {_CORR} AS c FROM p GROUP BY i, j)") + "SELECT round(sqrt(2 * sum(c * c)), 5) AS distance FROM c",
}
