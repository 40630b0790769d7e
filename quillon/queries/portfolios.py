"""Queries of allocation, optimizers and multi-path portfolios, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators import cross_section as xs
from ..operators import optimizers as op
from ..operators import portfolio as pf
from ..operators.validate import PortfolioSettings
from ..sources import synthetic as syn
from ..sources.scratch import table
from ..sources.synthetic import ASSETS, CALENDAR, PANEL, PREDICTIONS
from .cross_section import _CORR, _r, _with

SETTINGS = PortfolioSettings()


def equal_weight_backtest(spark, d):
    r = syn.asset_returns(spark, d)
    w = al.equal_weights(r.where("month(date) % 3 = 0"))
    return al.portfolio_backtest(w, r, 10).select("rebalance_date", "date", *[_r(c, 6) for c in ("gross", "turnover", "net", "nav")])


def rolling_cov(spark, d):
    return al.covariance(syn.asset_returns(spark, d)).select("row", "col", _r("value", 6))


def correlation_of(spark, d):
    return al.correlation_of(al.with_ridge(al.covariance(syn.asset_returns(spark, d)))).select("row", "col", _r("value", 6))


def inverse_vol(spark, d):
    return al.inverse_volatility(syn.asset_returns(spark, d)).select("asset", _r("weight"))


def simplex_projection(spark, d):
    rows = syn.asset_returns(spark, d).select("date", "asset", F.col("ret").alias("value"))
    return al.simplex_projection(rows).select("date", "asset", _r("weight", 6))


def normalize_long(spark, d):
    rows = syn.asset_returns(spark, d).select("date", "asset", F.col("ret").alias("weight"))
    return al.normalize_long(rows).select("date", "asset", _r("weight", 6))


def _yearly_cov(spark, d) -> DataFrame:
    """A covariance of complete pairs for each calendar year."""
    a = syn.asset_returns(spark, d).withColumn("year", F.year("date"))
    return a.select("year", "date", F.col("asset").alias("row"), F.col("ret").alias("x")).join(a.select("year", "date", F.col("asset").alias("col"), F.col("ret").alias("y")), ["year", "date"]).groupBy("year", "row", "col").agg(F.covar_samp("x", "y").alias("value")).where("value IS NOT NULL")


def _weights(method: str):
    def run(spark, d):
        return op.optimize(_yearly_cov(spark, d), method, ["year"]).select("year", "asset", _r("weight", 6))

    run.__name__ = method
    return run


def risk_budget(spark, d):
    return op.optimize(_yearly_cov(spark, d), lambda c: op.risk_budget(c, 1.0 + op.np.arange(len(c)) % 3), ["year"])


def olmar(spark, d):
    rows = syn.asset_returns(spark, d).select(F.lit("all").alias("strategy"), "date", "asset", (1 + F.col("ret")).alias("relative"))
    return op.olmar(rows).select("strategy", "date", "asset", _r("weight", 6))


def ic_diagnostics(spark, d):
    return pf.diagnostics(syn.predictions(spark, d)).select("model", "date", "candidates", "valid", "missing", _r("ic"), _r("valid_rate"))


def label_coverage(spark, d):
    return pf.label_coverage(pf.diagnostics(syn.predictions(spark, d)))


def rank_ic_paths(spark, d):
    return pf.rank_ic_paths(pf.diagnostics(syn.predictions(spark, d)), syn.calendar(spark, d), 3).select("model", F.col("path").cast("long").alias("path"), _r("ic_mean"), "n_dates")


def rank_ic_over_paths(spark, d):
    paths = pf.rank_ic_paths(pf.diagnostics(syn.predictions(spark, d)), syn.calendar(spark, d), 3)
    return pf.rank_ic_over_paths(paths, 3).select("model", _r("ic_mean", 6), _r("ic_std", 6), _r("ic_median", 6), _r("positive_rate"), "paths")


def _groups(spark, d):
    return table(xs.descending_groups(syn.predictions(spark, d), SETTINGS.n_groups), "groups")


def _schedule(spark, d):
    """Groups are written once, without the labels: a schedule reads them several times."""
    groups = xs.descending_groups(syn.scores(spark, d), SETTINGS.n_groups).select("model", "stock_code", "date", "group")
    return pf.schedule(table(groups, "groups"), syn.calendar(spark, d), SETTINGS)


def path_schedule(spark, d):
    out = _schedule(spark, d)
    return out.select("model", F.col("path").cast("long").alias("path"), F.col("group").cast("long").alias("grp"), "signal_date", "execution_date", "kind", F.size("targets").cast("long").alias("n_targets"))


def _market(spark, d):
    return syn.panel(spark, d).select("stock_code", "date", F.col("px").alias("price"), ((F.col("stock_code") + F.month("date")) % 9 != 0).alias("tradable"))


def _records(spark, d, kind):
    """The schedule is written once, too: a simulation reads its dates and its targets."""
    events = table(_schedule(spark, d), "events")
    return pf.simulate(events, pf.prepare_market(_market(spark, d)), SETTINGS, [kind])


def simulate_paths(spark, d):
    return _records(spark, d, "nav").select("model", "path", "group", "date", _r("nav", 6), _r("daily_return", 6), _r("fee", 4))


def trades(spark, d):
    return _records(spark, d, "trade").select("model", "path", "group", "date", "stock_code", "side", "status", _r("executed", 4))


def holdings(spark, d):
    return _records(spark, d, "holding").select("model", "path", "group", "date", "stock_code", _r("weight", 6))


def top_bottom_returns(spark, d):
    return pf.portfolio_returns(_records(spark, d, "nav"), SETTINGS.n_groups).select("model", "path", "portfolio", "date", _r("daily_return", 6), _r("nav", 6))


def _paths(spark, d):
    """Group returns dealt to three paths by month: what the path metrics need, without a simulation."""
    g = _groups(spark, d).where("label IS NOT NULL").groupBy("model", "group", "date").agg(F.avg("label").alias("daily_return"))
    return g.withColumn("path", (F.month("date") % 3).cast("long")).withColumn("portfolio", F.col("group").cast("long"))


def path_metrics_by_year(spark, d):
    out = pf.path_metrics(_paths(spark, d), 12)
    return out.select("model", "path", "portfolio", "period", *[_r(c, 5) for c in ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "win_rate")], "n")


def metrics_over_paths(spark, d):
    return pf.metrics_over_paths(pf.path_metrics(_paths(spark, d), 12)).select("model", "portfolio", "period", *[_r(c, 5) for c in ("annual_return", "max_drawdown", "win_rate")], "paths")


def daily_path_mean(spark, d):
    nav = _paths(spark, d).withColumn("nav", 1 + F.col("daily_return")).select("model", "portfolio", "path", F.trunc("date", "quarter").alias("date"), "nav")
    return pf.daily_path_aggregate(nav, ("model", "portfolio")).select("model", "portfolio", "date", _r("nav", 6), "paths", _r("daily_return", 6))


def monotonicity(spark, d):
    rows = _paths(spark, d).groupBy("model", "group").agg(F.round(F.avg("daily_return"), 10).alias("annual_return"))
    return pf.monotonicity(rows).select("model", *[_r(c, 6) for c in ("spearman", "monotonicity", "ordered_share", "top_bottom")])


def monthly_ic_chart(spark, d):
    """Mean IC of each year by path, then over the paths."""
    ic = pf.diagnostics(syn.predictions(spark, d)).withColumn("path", F.month("date") % 3)
    by_path = ic.groupBy("model", F.year("date").cast("long").alias("year"), "path").agg(F.avg("ic").alias("ic"))
    return by_path.groupBy("model", "year").agg(F.avg("ic").alias("ic")).select("model", "year", _r("ic"))


QUERIES = {f.__name__: f for f in (equal_weight_backtest, rolling_cov, correlation_of, inverse_vol, simplex_projection, normalize_long, *map(_weights, op.METHODS), risk_budget, olmar, ic_diagnostics, label_coverage, rank_ic_paths, rank_ic_over_paths, path_schedule, simulate_paths, trades, holdings, top_bottom_returns, path_metrics_by_year, metrics_over_paths, daily_path_mean, monotonicity, monthly_ic_chart)}

_COV = "cov AS (SELECT a.asset AS row, b.asset AS col, covar_samp(a.ret, b.ret) AS value FROM assets a JOIN assets b ON a.date = b.date GROUP BY 1, 2)"
_DIAG = f"""pred AS (SELECT model, date, count(*) AS candidates, count(label) AS valid FROM predictions GROUP BY 1, 2),
pr AS (SELECT model, date, rank() OVER (PARTITION BY model, date ORDER BY prediction) + (count(*) OVER (PARTITION BY model, date, prediction) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (PARTITION BY model, date ORDER BY label) + (count(*) OVER (PARTITION BY model, date, label) - 1) / 2.0::DOUBLE AS y FROM predictions WHERE prediction IS NOT NULL AND label IS NOT NULL),
pic AS (SELECT model, date, {_CORR} AS ic FROM pr GROUP BY 1, 2),
diag AS (SELECT pred.*, candidates - valid AS missing, ic FROM pred LEFT JOIN pic ON pic.model = pred.model AND pic.date = pred.date)"""
_RIP = "rip AS (SELECT model, path, avg(ic) AS ic_mean, count(*) AS n_dates FROM (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY date) - 1) % 3 AS path FROM diag) GROUP BY 1, 2)"
_DESC = "dg AS (SELECT *, ((row_number() OVER (PARTITION BY model, date ORDER BY prediction DESC, stock_code) - 1) * 5) // count(*) OVER (PARTITION BY model, date) + 1 AS grp FROM predictions)"
_GR = "gr AS (SELECT model, grp, date, avg(label) AS daily_return, month(date) % 3 AS path FROM dg WHERE label IS NOT NULL GROUP BY 1, 2, 3)"
_PM = """pp AS (SELECT model, path, grp, date, daily_return AS r, p.period FROM gr, (SELECT unnest(['all', 'year']) AS period) p),
pq AS (SELECT model, path, grp, date, r, CASE period WHEN 'all' THEN 'all' ELSE CAST(year(date) AS VARCHAR) END AS period FROM pp),
pn AS (SELECT *, product(1 + r) OVER (PARTITION BY model, path, grp, period ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM pq),
pd AS (SELECT *, greatest(0, 1 - nav / greatest(1, max(nav) OVER (PARTITION BY model, path, grp, period ORDER BY date ROWS UNBOUNDED PRECEDING))) AS dd FROM pn),
pm AS (SELECT model, path, grp AS portfolio, period, pow(product(1 + r), 12.0 / count(*)) - 1 AS annual_return, stddev_samp(r) * sqrt(12) AS annual_volatility, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, max(dd) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, count(*) AS n FROM pd GROUP BY 1, 2, 3, 4)"""

ORACLE_SQL = {
    "equal_weight_backtest": _with(ASSETS, "rb AS (SELECT date, count(*) AS n FROM assets WHERE month(date) % 3 = 0 GROUP BY 1)", "nx AS (SELECT rb.date, n, (SELECT min(date) FROM assets a WHERE a.date > rb.date) AS earn FROM rb)", "ok AS (SELECT *, row_number() OVER (ORDER BY date) AS seq FROM nx WHERE earn IS NOT NULL)",
        "h AS (SELECT ok.seq, ok.date, ok.earn, a.asset, 1.0::DOUBLE / n AS weight, coalesce(b.ret, 0) AS ret FROM ok JOIN assets a ON a.date = ok.date LEFT JOIN assets b ON b.date = ok.earn AND b.asset = a.asset)",
        "dr AS (SELECT *, weight * (1 + ret) / sum(weight * (1 + ret)) OVER (PARTITION BY seq) AS drifted FROM h)",
        "tu AS (SELECT coalesce(h.seq, p.seq + 1) AS seq, sum(coalesce(h.weight * h.ret, 0)) AS gross, sum(abs(coalesce(h.weight, 0) - coalesce(p.drifted, 0))) AS turnover FROM h FULL JOIN dr p ON p.seq + 1 = h.seq AND p.asset = h.asset GROUP BY 1)",
        "o AS (SELECT ok.date AS rebalance_date, ok.earn AS date, gross, turnover, gross - turnover * 10 / 10000.0::DOUBLE AS net FROM ok JOIN tu ON tu.seq = ok.seq)")
    + "SELECT rebalance_date, date, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(net, 6) + 0.0 AS net, round(product(1 + net) OVER (ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS nav FROM o",
    "rolling_cov": _with(ASSETS, _COV) + "SELECT row, col, round(value, 6) + 0.0 AS value FROM cov",
    "correlation_of": _with(ASSETS, _COV, "rc AS (SELECT row, col, value + CASE WHEN row = col THEN 0.00000001 ELSE 0 END AS value FROM cov)", "v AS (SELECT row AS i, value AS v FROM rc WHERE row = col)") + "SELECT row, col, round(CASE WHEN row = col THEN 1 ELSE greatest(-1, least(1, value / sqrt(a.v * b.v))) END, 6) + 0.0 AS value FROM rc JOIN v a ON a.i = row JOIN v b ON b.i = col",
    "inverse_vol": _with(ASSETS, "s AS (SELECT asset, 1 / stddev_samp(ret) AS w FROM assets GROUP BY 1)") + "SELECT asset, round(w / sum(w) OVER (), 7) + 0.0 AS weight FROM s",
    "simplex_projection": _with(ASSETS, "k AS (SELECT date, asset, ret, row_number() OVER w AS k, sum(ret) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM assets WINDOW w AS (PARTITION BY date ORDER BY ret DESC, asset))", "t AS (SELECT date, arg_max((s - 1) / k, k) AS theta FROM k WHERE ret > (s - 1) / k GROUP BY 1)") + "SELECT a.date, asset, round(greatest(ret - theta, 0), 6) + 0.0 AS weight FROM assets a JOIN t ON t.date = a.date",
    "normalize_long": _with(ASSETS, "p AS (SELECT date, asset, greatest(ret, 0) AS p, sum(greatest(ret, 0)) OVER (PARTITION BY date) AS t, count(*) OVER (PARTITION BY date) AS n FROM assets)") + "SELECT date, asset, round(CASE WHEN t > 0 THEN p / t ELSE 1.0 / n END, 6) + 0.0 AS weight FROM p",
    "ic_diagnostics": _with(PANEL, PREDICTIONS, _DIAG) + "SELECT model, date, candidates, valid, missing, round(ic, 7) + 0.0 AS ic, round(valid / candidates::DOUBLE, 7) + 0.0 AS valid_rate FROM diag",
    "label_coverage": _with(PANEL, PREDICTIONS, _DIAG) + "SELECT model, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(missing) AS BIGINT) AS missing FROM diag GROUP BY 1",
    "rank_ic_paths": _with(PANEL, PREDICTIONS, _DIAG, _RIP) + "SELECT model, path, round(ic_mean, 7) + 0.0 AS ic_mean, n_dates FROM rip",
    "rank_ic_over_paths": _with(PANEL, PREDICTIONS, _DIAG, _RIP) + "SELECT model, round(avg(ic_mean), 6) + 0.0 AS ic_mean, round(stddev_samp(ic_mean), 6) + 0.0 AS ic_std, round(median(ic_mean), 6) + 0.0 AS ic_median, round(avg(CASE WHEN ic_mean > 0 THEN 1.0::DOUBLE ELSE 0 END), 7) + 0.0 AS positive_rate, count(*) AS paths FROM rip GROUP BY 1",
    "path_schedule": _with(PANEL, CALENDAR, PREDICTIONS, _DESC, "md AS (SELECT model, c.date, trade_index, (row_number() OVER (PARTITION BY model ORDER BY c.date) - 1) % 3 AS path FROM calendar c, (SELECT model, min(date) AS lo, max(date) AS hi FROM dg GROUP BY 1) s WHERE c.date BETWEEN lo AND hi)",
        "ev AS (SELECT md.model, path, g.grp, md.date AS signal_date, md.trade_index, e.date AS execution_date, (SELECT count(*) FROM dg WHERE dg.model = md.model AND dg.grp = g.grp AND dg.date = md.date) AS n_targets FROM md JOIN calendar e ON e.trade_index = md.trade_index + 1 JOIN (SELECT DISTINCT model, grp FROM dg) g ON g.model = md.model)",
        "ef AS (SELECT *, min(CASE WHEN n_targets > 0 THEN execution_date END) OVER (PARTITION BY model, path, grp) AS f FROM ev)", "es AS (SELECT * FROM ef WHERE execution_date >= f)")
    + """SELECT model, path, CAST(grp AS BIGINT) AS grp, signal_date, execution_date, 'rebalance' AS kind, n_targets FROM es
 UNION ALL SELECT l.model, path, CAST(grp AS BIGINT), signal_date, x.date, 'final_exit', 0 FROM (SELECT model, path, grp, max(signal_date) AS signal_date, max(trade_index) AS t FROM es GROUP BY 1, 2, 3) l JOIN calendar x ON x.trade_index = l.t + 4""",
    "path_metrics_by_year": _with(PANEL, PREDICTIONS, _DESC, _GR, _PM) + "SELECT model, path, CAST(portfolio AS BIGINT) AS portfolio, period, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "win_rate")) + ", n FROM pm",
    "metrics_over_paths": _with(PANEL, PREDICTIONS, _DESC, _GR, _PM) + "SELECT model, CAST(portfolio AS BIGINT) AS portfolio, period, " + ", ".join(f"round(avg({c}), 5) + 0.0 AS {c}" for c in ("annual_return", "max_drawdown", "win_rate")) + ", count(DISTINCT path) AS paths FROM pm GROUP BY 1, 2, 3",
    "daily_path_mean": _with(PANEL, PREDICTIONS, _DESC, _GR, "q AS (SELECT model, grp AS portfolio, CAST(date_trunc('quarter', date) AS DATE) AS date, avg(1 + daily_return) AS nav, count(*) AS paths FROM gr GROUP BY 1, 2, 3)")
    + "SELECT model, CAST(portfolio AS BIGINT) AS portfolio, date, round(nav, 6) + 0.0 AS nav, paths, round(nav / coalesce(lag(nav) OVER (PARTITION BY model, portfolio ORDER BY date), 1) - 1, 6) + 0.0 AS daily_return FROM q",
    "monotonicity": _with(PANEL, PREDICTIONS, _DESC, _GR, "a AS (SELECT model, grp, round(avg(daily_return), 10) AS v FROM gr GROUP BY 1, 2)", "b AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0::DOUBLE AS r, lead(v) OVER (PARTITION BY model ORDER BY grp) AS nx FROM a)")
    + "SELECT model, round(corr(grp, r), 6) + 0.0 AS spearman, round(-corr(grp, r), 6) + 0.0 AS monotonicity, round(avg(CASE WHEN nx IS NOT NULL THEN CASE WHEN v >= nx THEN 1.0::DOUBLE ELSE 0 END END), 6) + 0.0 AS ordered_share, round(arg_min(v, grp) - arg_max(v, grp), 6) + 0.0 AS top_bottom FROM b GROUP BY 1",
    "monthly_ic_chart": _with(PANEL, PREDICTIONS, _DIAG, "m AS (SELECT model, year(date) AS year, month(date) % 3 AS path, avg(ic) AS ic FROM diag GROUP BY 1, 2, 3)") + "SELECT model, CAST(year AS BIGINT) AS year, round(avg(ic), 7) + 0.0 AS ic FROM m GROUP BY 1, 2",
}
