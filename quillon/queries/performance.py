"""Queries of metrics, factor backtests and timing, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as mx
from ..operators import cross_section as xs
from ..operators import factor, timing
from ..sources import synthetic as syn
from ..sources.synthetic import PANEL, SERIES
from .cross_section import _GROUPS, _r, _with


def _rounded(df, keys, cols, digits=6, longs=()):
    return df.select(*keys, *[_r(c, digits) for c in cols], *[F.col(c).cast("long").alias(c) for c in longs])


def perf_summary(spark, d):
    out = mx.performance_summary(syn.series(spark, d).where("ret IS NOT NULL"), ["series_id"], periods=252)
    return _rounded(out, ["series_id"], ["annual_return", "annual_volatility", "sharpe", "max_drawdown", "win_rate", "total_return", "calmar"], longs=["n"])


def risk_metrics(spark, d):
    r, b = F.col("ret"), F.col("b")
    rows = syn.series(spark, d).where("ret IS NOT NULL").withColumn("b", F.col("ret") * 2 + 0.001)
    out = rows.groupBy("series_id").agg(
        mx.arithmetic_annual_return(r, 252).alias("arithmetic"), mx.downside_deviation(r, 0.001).alias("downside"), mx.sortino(r, 0.0001, 252).alias("sortino"),
        mx.modigliani(r, b, 0.0001, 252).alias("m2"), mx.historical_var(r, 0.05).alias("var5"), mx.psr_z(r).alias("psr_z"),
    )
    return _rounded(out, ["series_id"], ["arithmetic", "downside", "sortino", "m2", "var5", "psr_z"], 5)


def psr_probability(spark, d):
    return syn.series(spark, d).where("ret IS NOT NULL").groupBy("series_id").agg(F.round(mx.psr_z(F.col("ret")), 5).alias("z")).select("series_id", F.round(mx.psr(F.col("z")), 6).alias("psr"))


def nav_drawdown(spark, d):
    rows = mx.drawdown(mx.wealth(syn.series(spark, d)))
    return _rounded(rows, ["series_id", "date"], ["nav", "drawdown"])


def group_turnover(spark, d):
    rows = xs.quantile_groups(syn.panel(spark, d).where("factor IS NOT NULL"), n=5)
    return factor.group_turnover(rows).select(F.col("group").cast("long").alias("grp"), "date", _r("turnover"))


def quantile_backtest(spark, d):
    return _rounded(factor.quantile_backtest(syn.panel(spark, d)), ["date", "series"], ["gross", "net", "nav"], 6)


def quantile_backtest_strict(spark, d):
    return _rounded(factor.quantile_backtest(syn.panel(spark, d), per_period_cost=True), ["date", "series"], ["gross", "net", "nav"], 6)


def long_short_performance(spark, d):
    out = factor.performance_analysis(syn.panel(spark, d)).performance.where("series = 'long_short'")
    return _rounded(out, ["series"], ["annual_return", "annual_volatility", "sharpe", "max_drawdown", "win_rate"], 5, ["n"])


def signal_backtest(spark, d):
    return _rounded(timing.signal_backtest(syn.series(spark, d), cost_bps=5), ["series_id", "date"], ["position", "turnover", "net", "nav", "bench_nav"])


def timing_metrics(spark, d):
    out = timing.timing_metrics(timing.signal_backtest(syn.series(spark, d), cost_bps=5))
    return _rounded(out, ["series_id"], ["annual_return", "annual_volatility", "max_drawdown", "bench_annual_return", "win_rate", "profit_loss_ratio", "holding_share", "sharpe", "excess_return"], 5, ["trade_count", "n"])


QUERIES = {f.__name__: f for f in (perf_summary, risk_metrics, psr_probability, nav_drawdown, group_turnover, quantile_backtest, quantile_backtest_strict, long_short_performance, signal_backtest, timing_metrics)}

_NAV = """w AS (SELECT *, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) END AS nav FROM {src}),
dd AS (SELECT *, greatest(0, 1 - nav / greatest(1.0, max(nav) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))) AS drawdown FROM w)"""
_VALID = "valid AS (SELECT * FROM series WHERE ret IS NOT NULL)"
_PERF = """round(pow(product(1 + ret), {p}.0 / count(*)) - 1, {k}) + 0.0 AS annual_return, round(stddev_samp(ret) * sqrt({p}), {k}) + 0.0 AS annual_volatility, round(avg(ret) / stddev_samp(ret) * sqrt({p}), {k}) + 0.0 AS sharpe,
 round(max(drawdown), {k}) + 0.0 AS max_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), {k}) AS win_rate"""
_TURN = """size AS (SELECT grp AS g, date AS d, count(*) AS size, row_number() OVER (PARTITION BY grp ORDER BY date) AS seq, lag(count(*)) OVER (PARTITION BY grp ORDER BY date) AS before FROM {src} GROUP BY 1, 2),
member AS (SELECT grp AS g, date AS d, stock_code AS s, seq FROM {src} JOIN size ON grp = g AND date = d),
common AS (SELECT a.g, a.d, count(*) AS n FROM member a JOIN member b ON a.g = b.g AND a.s = b.s AND a.seq = b.seq + 1 GROUP BY 1, 2),
turn AS (SELECT size.g, size.d, 1 - coalesce(n, 0) / greatest(size, before)::DOUBLE AS turnover FROM size LEFT JOIN common ON common.g = size.g AND common.d = size.d WHERE before IS NOT NULL)"""
_BACK = (
    _GROUPS.replace("ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, stock_code) AS r, count(*) OVER (PARTITION BY date) AS m FROM panel WHERE factor IS NOT NULL)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, stock_code) AS r, count(*) OVER (PARTITION BY date) AS m FROM panel WHERE factor IS NOT NULL AND fwd IS NOT NULL)")
    + ",\n"
    + _TURN.format(src="grouped")
)
_ALL = """gross AS (SELECT a.date, a.grp, a.gross, 0.003::DOUBLE * coalesce({turn}, 0) AS fee FROM (SELECT date, grp, avg(fwd) AS gross FROM grouped GROUP BY 1, 2) a LEFT JOIN {src}),
series AS (SELECT date, 'group_' || grp AS series_id, gross, gross - fee AS ret FROM gross
 UNION ALL SELECT date, 'long_short', max(CASE WHEN grp = 5 THEN gross END) - max(CASE WHEN grp = 1 THEN gross END),
  max(CASE WHEN grp = 5 THEN gross END) - max(CASE WHEN grp = 1 THEN gross END) - max(CASE WHEN grp = 5 THEN fee END) {sign} max(CASE WHEN grp = 1 THEN fee END) FROM gross GROUP BY 1)"""
_MEAN = _ALL.format(turn="t", src="(SELECT g, avg(turnover) AS t FROM turn GROUP BY 1) b ON b.g = a.grp", sign="+")
_OWN = _ALL.format(turn="turnover", src="turn b ON b.g = a.grp AND b.d = a.date", sign="-")
_OUT = "SELECT date, series_id AS series, round(gross, 6) + 0.0 AS gross, round(ret, 6) + 0.0 AS net, round(nav, 6) + 0.0 AS nav FROM w"
_SIGNAL = """pos AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS position FROM series WINDOW w AS (PARTITION BY series_id ORDER BY date)),
tr AS (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover FROM pos WINDOW w AS (PARTITION BY series_id ORDER BY date)),
nt AS (SELECT *, coalesce(position * ret, 0) - turnover * 5 / 10000.0::DOUBLE AS net FROM tr),
sb AS (SELECT *, product(1 + net) OVER w AS nav, product(1 + coalesce(ret, 0)) OVER w AS bench_nav FROM nt WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))"""

ORACLE_SQL = {
    "perf_summary": _with(SERIES, _VALID, _NAV.format(src="valid")) + f"SELECT series_id, {_PERF.format(p=252, k=6)}, round(product(1 + ret) - 1, 6) + 0.0 AS total_return, round((pow(product(1 + ret), 252.0 / count(*)) - 1) / max(drawdown), 6) + 0.0 AS calmar, count(*) AS n FROM dd GROUP BY 1",
    "risk_metrics": _with(SERIES, "v AS (SELECT series_id, ret AS r, ret * 2 + 0.001 AS b FROM series WHERE ret IS NOT NULL)", """m AS (SELECT series_id, count(r)::DOUBLE AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r - 0.0001) AS sdx, stddev_samp(b) AS sdb, sqrt(avg(pow(least(r - 0.001, 0), 2))) AS downside, sqrt(avg(pow(least(r - 0.0001, 0), 2))) AS dd, quantile_cont(r, 0.05) AS q,
 var_pop(r) AS var, avg(r * r) AS m2, avg(r * r * r) AS m3, avg(r * r * r * r) AS m4 FROM v GROUP BY 1)""", """g AS (SELECT *, (m3 - 3 * mean * m2 + 2 * pow(mean, 3)) / pow(var, 1.5) AS g1, (m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * pow(mean, 4)) / (var * var) - 3 AS g2, mean / sd AS sr FROM m),
k AS (SELECT *, g1 * sqrt(n * (n - 1)) / (n - 2) AS sk, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3 AS ku FROM g)""")
    + """SELECT series_id, round(mean * 252, 5) + 0.0 AS arithmetic, round(downside, 5) + 0.0 AS downside, round((mean - 0.0001) * 252 / (dd * sqrt(252)), 5) + 0.0 AS sortino, round((mean - 0.0001) / sdx * sqrt(252) * sdb * sqrt(252) + 0.0001 * 252, 5) + 0.0 AS m2,
 round(-q, 5) + 0.0 AS var5, round(sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr), 5) + 0.0 AS psr_z FROM k""",
    "nav_drawdown": _with(SERIES, _NAV.format(src="series")) + "SELECT series_id, date, round(nav, 6) + 0.0 AS nav, round(CASE WHEN nav IS NULL THEN 0 ELSE drawdown END, 6) + 0.0 AS drawdown FROM dd",
    "group_turnover": _with(PANEL, _GROUPS, _TURN.format(src="grouped")) + "SELECT CAST(g AS BIGINT) AS grp, d AS date, round(turnover, 7) + 0.0 AS turnover FROM turn",
    "quantile_backtest": _with(PANEL, _BACK, _MEAN, _NAV.format(src="series")) + _OUT,
    "quantile_backtest_strict": _with(PANEL, _BACK, _OWN, _NAV.format(src="series")) + _OUT,
    "long_short_performance": _with(PANEL, _BACK, _MEAN, _NAV.format(src="series")) + f"SELECT series_id AS series, {_PERF.format(p=12, k=5)}, count(*) AS n FROM dd WHERE series_id = 'long_short' GROUP BY 1",
    "signal_backtest": _with(SERIES, _SIGNAL) + "SELECT series_id, date, round(position, 6) + 0.0 AS position, round(turnover, 6) + 0.0 AS turnover, round(net, 6) + 0.0 AS net, round(nav, 6) + 0.0 AS nav, round(bench_nav, 6) + 0.0 AS bench_nav FROM sb",
    "timing_metrics": _with(SERIES, _SIGNAL, """q AS (SELECT *, nav / coalesce(lag(nav) OVER w, 1) - 1 AS r, 1 - nav / greatest(1, max(nav) OVER (w ROWS UNBOUNDED PRECEDING)) AS dd, position <> coalesce(lag(position) OVER w, 0) AS trade FROM sb WINDOW w AS (PARTITION BY series_id ORDER BY date)),
m AS (SELECT series_id, pow(arg_max(nav, date), 252.0 / count(*)) - 1 AS ar, stddev_samp(r) * sqrt(252) AS av, max(dd) AS md, pow(arg_max(bench_nav, date), 252.0 / count(*)) - 1 AS br, avg(CASE WHEN position <> 0 THEN CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END END) AS wr,
 sum(CASE WHEN position <> 0 AND r > 0 THEN r END) / sum(CASE WHEN position <> 0 AND r < 0 THEN -r END) AS pl, sum(CASE WHEN trade THEN 1 ELSE 0 END) AS tc, avg(CASE WHEN position <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS hs, count(*) AS n FROM q GROUP BY 1)""")
    + """SELECT series_id, round(ar, 5) + 0.0 AS annual_return, round(av, 5) + 0.0 AS annual_volatility, round(md, 5) + 0.0 AS max_drawdown, round(br, 5) + 0.0 AS bench_annual_return, round(coalesce(wr, 0), 5) + 0.0 AS win_rate, round(coalesce(pl, 0), 5) + 0.0 AS profit_loss_ratio,
 round(hs, 5) + 0.0 AS holding_share, round(CASE WHEN av > 0 THEN ar / av ELSE 0 END, 5) + 0.0 AS sharpe, round(ar - br, 5) + 0.0 AS excess_return, CAST(tc AS BIGINT) AS trade_count, n FROM m""",
}

ORACLE_SQL["psr_probability"] = f"""SELECT series_id, round(0.5 + sign(psr_z) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest(abs(psr_z), 1e-12::DOUBLE)) - psr_z * psr_z / 2 - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) FOR k IN range(0, 600)]), 6) AS psr
FROM ({ORACLE_SQL["risk_metrics"]})"""
