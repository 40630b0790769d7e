"""Queries of gates and of chart and reference tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as ch
from ..operators import portfolio as pf
from ..plans import gates
from ..sources import synthetic as syn
from ..sources.synthetic import PANEL, PREDICTIONS
from . import performance, portfolios
from .cross_section import _r, _with


def _case(spark, d, name, key):
    return syn.table(spark, d, name).withColumn("case_id", F.col(key))


def gate_init(spark, d):
    """Every line of a document on a page of its own; some are said to have a page more."""
    docs = syn.table(spark, d, "documents")
    pages = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" =====\n"), line))
    text = F.when(F.col("doc_id") % 7 != 0, F.array_join(pages, "\n"))
    cases = docs.select(F.col("doc_id").alias("case_id"), text.alias("text"), (F.size(F.split("text", "\n", -1)) + (F.col("doc_id") % 5 == 0).cast("int")).alias("pdf_pages"))
    return gates.init_gate(cases)


def gate_extract(spark, d):
    """A specification for each supplier, with as many elements as its key says and faults by rule."""
    k = F.col("s_suppkey")
    n = (k % 4 + 1).cast("int")
    block = lambda i: F.concat(F.lit("### ["), F.when((i == 1) & (k % 5 != 0), "R").otherwise("D"), i.cast("string"), F.lit("] title\n- 页码: 3\n"), F.when((k % 6 != 0) | (i > 1), "- 原文: words\n").otherwise(""))
    figures = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("| FIG"), i.cast("string"), F.lit(" | t |"))), "\n")
    head = F.concat(F.lit("---\ntitle: t\nelement_counts:\n  D: "), (n + (k % 7 == 0).cast("int") - (k % 5 != 0).cast("int")).cast("string"), F.lit("\n  R: "), (k % 5 != 0).cast("int").cast("string"), F.lit("\n  FIG_registered: "), n.cast("string"), F.lit("\nexhibit_declared:\n  fig_max: "), (n - (k % 8 == 0).cast("int")).cast("string"), F.lit("\n---\n"))
    spec = F.concat(F.when(k % 11 != 0, head).otherwise(""), F.array_join(F.transform(F.sequence(F.lit(1), n), block), ""), F.lit("## 图表登记\n"), figures, F.lit("\n"))
    matrix = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("| D"), i.cast("string"), F.lit(" | done |"))), "\n")
    return gates.extract_gate(syn.table(spark, d, "supplier").select(k.alias("case_id"), spec.alias("spec"), matrix.alias("coverage_matrix")))


def gate_audit(spark, d):
    """Orders as cases, their lines as findings, responses and differences."""
    lines = _case(spark, d, "lineitem", "l_orderkey")
    responses = lines.select("case_id", F.when(F.col("l_linenumber") % 3 == 0, "Critical").when(F.col("l_linenumber") % 3 == 1, "major").alias("severity"), F.when(F.col("l_returnflag") != "N", "PASS").alias("recheck"), F.when(F.col("l_tax") > 0.01, "fixed").otherwise(" ").alias("disposition"))
    diffs = lines.select("case_id", F.when(F.col("l_discount") > 0.01, "ours").alias("ruling"))
    return gates.audit_gate(_case(spark, d, "orders", "o_orderkey"), lines.where("l_quantity > 4"), responses, diffs)


def gate_code_audit(spark, d):
    """Suppliers as cases; those with an even key have an audit."""
    k = F.col("s_suppkey")
    cases = _case(spark, d, "supplier", "s_suppkey").select("case_id", F.when(k % 3 == 0, "easy").alias("difficulty"), F.when(k % 9 == 0, F.array(F.lit("ml"))).alias("tags"))
    text = F.when(k % 12 == 0, "x\n判定：NotFound\n").when(k % 10 == 0, "- 判定: not_found").otherwise("not_found is only mentioned\n判定: ok")
    return gates.code_audit_gate(cases, _case(spark, d, "supplier", "s_suppkey").where(k % 2 == 0).select("case_id", text.alias("text")))


def gate_implement(spark, d):
    lines = _case(spark, d, "lineitem", "l_orderkey")
    milestones = lines.select("case_id", F.when(F.col("l_linestatus") == "F", "done").alias("implement"))
    matrix = lines.select("case_id", F.when(F.col("l_returnflag") == "N", "skipped").otherwise("done").alias("state"), F.when(F.col("l_tax") > 0, "src/main").alias("location"))
    return gates.implement_gate(_case(spark, d, "orders", "o_orderkey"), milestones, matrix)


SAID = ["结论: stop_partial", "结论：**blocked**（说明）", "结论: continue（已排除 stop_partial 假设）", "已排除假设\n结论: continue", None]


def gate_iteration(spark, d):
    """Customers as cases; each of their orders is a file of a round, its key choosing round, name and text."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    cases = syn.table(spark, d, "customer").select(k.alias("case_id"), (k % 4).alias("current"), F.when(k % 5 > 0, 1 + k % 3).alias("most"))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    round_ = 1 + F.floor(o / 4) % 3
    text = pick(SAID, (F.col("o_custkey") * 3 + round_) % 5)
    files = syn.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), round_.alias("round"), pick(gates.ROUND_FILES, o % 3).alias("name"), F.when(o % 3 == 0, text).alias("text"))
    return gates.iteration_gate(cases, files)


def gate_report(spark, d):
    """Suppliers as cases, their nation's key choosing faults."""
    k = F.col("s_suppkey")
    parts = F.array(*[F.concat(F.lit(f"## {i}. {s}\n"), F.lit("text\n")) for i, s in enumerate(gates.SECTIONS)])
    report = F.concat(F.array_join(F.slice(parts, F.lit(1), F.when(k % 6 == 0, 7).otherwise(8)), ""), F.when(k % 4 == 0, "## 样本外表现\n").otherwise(""), F.when(k % 3 != 0, F.concat(F.lit("rejected: CDX-C-"), k.cast("string"))).otherwise(""))
    page = F.concat(F.lit("<h1>"), k.cast("string"), F.lit("</h1>指标对比总表"), F.repeat(F.lit("x"), F.when(k % 5 == 0, 100).otherwise(6000)))
    cases = _case(spark, d, "supplier", "s_suppkey").select("case_id", report.alias("report"), F.when(k % 8 == 0, "a [verify 后填] b").otherwise("a").alias("assumptions"), page.alias("page"), F.when(k % 7 != 0, k % 3).alias("coverage_total"), (k % 2 == 0).alias("oos_done"), (k % 50 == 0).alias("experimental"))
    matrix = _case(spark, d, "supplier", "s_suppkey").select("case_id", F.when(k % 9 == 0, "in_progress").otherwise("done").alias("state"))
    responses = _case(spark, d, "supplier", "s_suppkey").select("case_id", F.concat(F.lit("CDX-C-"), k.cast("string")).alias("finding_id"), F.when(k % 2 == 0, "rejected").otherwise("fixed").alias("disposition"))
    return gates.report_gate(cases, matrix, responses)


def _dated_ic(spark, d):
    return pf.diagnostics(syn.predictions(spark, d)).withColumn("path", F.month("date") % 3)


def ic_month_chart(spark, d):
    out = ch.ic_by_month(_dated_ic(spark, d))
    return out.select("model", "month", _r("ic"), "paths", *[F.col(c).cast("long").alias(c) for c in ("candidates", "valid", "missing")], _r("valid_rate"), _r("missing_rate"))


def ic_cumulative_chart(spark, d):
    return ch.ic_cumulative(_dated_ic(spark, d)).select("model", "date", _r("cumulative", 6))


def ic_histogram(spark, d):
    rounded = _dated_ic(spark, d).withColumn("ic", F.round("ic", 7))
    return ch.histogram(rounded, "ic").select("model", "bin", _r("low", 6), _r("high", 6), "n")


def group_wealth_chart(spark, d):
    nav = portfolios._paths(spark, d).select("model", "group", "path", F.trunc("date", "quarter").alias("date"), (1 + F.col("daily_return")).alias("nav"))
    return ch.group_wealth(nav, (1, 3, 5)).select("model", F.col("group").cast("long").alias("grp"), "date", _r("nav", 6), "paths", _r("cumulative_return", 6))


def group_return_bars(spark, d):
    return ch.group_bars(performance.quantile_backtest(spark, d)).select("series", _r("annual_return", 5))


def wealth_comparison(spark, d):
    return ch.wealth_comparison(performance.quantile_backtest(spark, d), 5)


def prediction_scatter(spark, d):
    return ch.scatter_points(syn.predictions(spark, d), 200, 7).select("model", "stock_code", "date", _r("prediction"), _r("label"))


def annual_chart(spark, d):
    return ch.annual_rows(portfolios.path_metrics_by_year(spark, d), (1, 5))


def resource_chart(spark, d):
    k = F.col("p_partkey")
    made = syn.table(spark, d, "part").select(k.alias("model"), F.when(k % 3 == 0, k * 10).alias("device_memory_bytes"), (k * 7).alias("process_memory_bytes"), F.when(k % 4 != 0, k % 2 == 0).alias("is_sparse_wiring"))
    return ch.resource_usage(made).select("model", "display_memory_bytes", "display_memory_scope", "wiring")


def reported_deviation(spark, d):
    """Reported numbers against the means over paths; a year that wasn't reproduced stays, without a value."""
    made = portfolios.metrics_over_paths(spark, d)
    reported = made.select("model", "portfolio", F.when(F.col("period") == "1995", "2095").otherwise(F.col("period")).alias("period"), (F.col("portfolio") / 10).alias("annual_return"), (F.col("portfolio") / 20).alias("win_rate"))
    elements = spark.createDataFrame([(p, f"R{p}") for p in (1, 5)], "portfolio long, element_id string")
    out = ch.deviations(reported, made, ["model", "portfolio", "period"], ["annual_return", "win_rate"], elements)
    return out.select("model", "portfolio", "period", "element_id", *[_r(c, 5) for c in ("report_annual_return", "annual_return", "annual_return_deviation", "report_win_rate", "win_rate", "win_rate_deviation")])


QUERIES = {f.__name__: f for f in (gate_init, gate_extract, gate_audit, gate_code_audit, gate_implement, gate_iteration, gate_report, ic_month_chart, ic_cumulative_chart, ic_histogram, group_wealth_chart, group_return_bars, wealth_comparison, prediction_scatter, annual_chart, resource_chart, reported_deviation)}


def _long(source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT case_id, '{n}' AS check_id, coalesce({c}, false) AS passed FROM {source}" for n, c in rules.items())


_DIAG, _PM, _GR, _DESC = portfolios._DIAG, portfolios._PM, portfolios._GR, portfolios._DESC
_BACKTEST, _YEARS, _OVER = performance.ORACLE_SQL["quantile_backtest"], portfolios.ORACLE_SQL["path_metrics_by_year"], portfolios.ORACLE_SQL["metrics_over_paths"]
_SECTIONS = "[" + ", ".join(f"'{s}'" for s in gates.SECTIONS) + "]"

ORACLE_SQL = {
    "gate_init": "WITH c AS (SELECT doc_id AS case_id, doc_id % 7 <> 0 AS there, len(string_split(text, chr(10))) AS n, len(string_split(text, chr(10))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS pages FROM documents) "
    + _long("c", {"text_exists": "there", "page_marks": "there", "pages_agree": "CASE WHEN there THEN n ELSE 0 END = pages"}),
    "gate_extract": "WITH c AS (SELECT s_suppkey AS case_id, s_suppkey AS k, s_suppkey % 4 + 1 AS n, s_suppkey % 11 <> 0 AS head FROM supplier) "
    + _long("c", {"front_matter": "head", "counts_agree": "head AND k % 7 <> 0", "blocks_have_evidence": "k % 6 <> 0", "has_result": "k % 5 <> 0", "exhibits_agree": "NOT head OR k % 8 <> 0"}),
    "gate_audit": """WITH a AS (SELECT l_orderkey AS case_id, count(*) AS answers, count(*) FILTER (WHERE l_quantity > 4) AS issues, count(*) FILTER (WHERE l_linenumber % 3 = 0 AND l_returnflag = 'N') AS open, count(*) FILTER (WHERE l_linenumber % 3 = 1 AND l_tax <= 0.01) AS silent, count(*) FILTER (WHERE l_discount <= 0.01) AS unruled FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS case_id, coalesce(answers, 0) AS answers, coalesce(issues, 0) AS issues, coalesce(open, 0) AS open, coalesce(silent, 0) AS silent, unruled FROM orders LEFT JOIN a ON a.case_id = o_orderkey) """
    + _long("c", {"diffs_ruled": "unruled = 0", "all_answered": "answers = issues", "no_open_critical": "open = 0", "majors_answered": "silent = 0"}),
    "gate_code_audit": "WITH c AS (SELECT s_suppkey AS case_id, s_suppkey AS k FROM supplier) " + _long("c", {"audited": "k % 2 = 0 OR (k % 3 = 0 AND k % 9 <> 0)", "nothing_missing": "k % 2 = 1 OR (k % 12 <> 0 AND k % 10 <> 0)"}),
    "gate_implement": """WITH a AS (SELECT l_orderkey AS case_id, count(*) FILTER (WHERE l_linestatus <> 'F') AS undone, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_tax <= 0) AS unplaced FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS case_id, coalesce(undone, 0) AS undone, coalesce(unplaced, 0) AS unplaced FROM orders LEFT JOIN a ON a.case_id = o_orderkey) """
    + _long("c", {"milestones_done": "undone = 0", "elements_placed": "unplaced = 0"}),
    "gate_iteration": f"""WITH f AS (SELECT o_custkey AS c, 1 + (o_orderkey // 4) % 3 AS round, (o_orderkey % 3)::INT AS name, ((o_custkey * 3 + 1 + (o_orderkey // 4) % 3) % 5)::INT AS said FROM orders),
p AS (SELECT c, round, bool_or(name = 0) AS d, bool_or(name = 1) AS e, bool_or(name = 2) AS j, bool_or(name = 0 AND said IN (0, 1)) AS over, bool_or(name = 0 AND said = 3) AS excludes FROM f GROUP BY ALL),
r AS (SELECT c_custkey AS c, unnest(range(1, c_custkey % 4 + 1)) AS round FROM customer),
m AS (SELECT r.c, r.round, unnest([CASE WHEN NOT coalesce(d, false) THEN 'diagnosis.md' END, CASE WHEN NOT coalesce(e, false) AND NOT coalesce(over, false) THEN 'changes.md' END, CASE WHEN NOT coalesce(j, false) THEN 'comparison.json' END]) AS name FROM r LEFT JOIN p ON p.c = r.c AND p.round = r.round),
l AS (SELECT c, string_agg(round || '/' || name, ',' ORDER BY round || '/' || name) AS missing FROM m WHERE name IS NOT NULL GROUP BY c),
s AS (SELECT DISTINCT r.c FROM r LEFT JOIN p ON p.c = r.c AND p.round = r.round WHERE r.round > 1 AND NOT coalesce(excludes, false))
SELECT c_custkey AS case_id, 'round_files' AS check_id, l.c IS NULL AS passed, coalesce(missing, '') AS missing FROM customer LEFT JOIN l ON l.c = c_custkey
UNION ALL SELECT c_custkey, 'rounds_allowed', c_custkey % 5 = 0 OR c_custkey % 4 <= 1 + c_custkey % 3, '' FROM customer
UNION ALL SELECT c_custkey, 'excluded_hypotheses', s.c IS NULL, '' FROM customer LEFT JOIN s ON s.c = c_custkey""",
    "gate_report": "WITH c AS (SELECT s_suppkey AS case_id, s_suppkey AS k FROM supplier) "
    + _long("c", {"sections": "k % 6 <> 0 AND (k % 2 = 1 OR k % 4 = 0) AND k % 50 <> 0", "nothing_open": "k % 9 <> 0", "no_placeholder": "k % 8 <> 0", "rejections_told": "k % 2 = 1 OR k % 3 <> 0", "page": "k % 5 <> 0", "coverage": "k % 7 <> 0 AND k % 3 > 0"}),
    "ic_month_chart": _with(PANEL, PREDICTIONS, _DIAG, "m AS (SELECT model, date_trunc('month', date)::DATE AS month, month(date) % 3 AS path, avg(ic) AS ic, sum(candidates) AS candidates, sum(valid) AS valid, sum(missing) AS missing FROM diag GROUP BY 1, 2, 3)")
    + "SELECT model, month, round(avg(ic), 7) + 0.0 AS ic, count(DISTINCT path) AS paths, sum(candidates)::BIGINT AS candidates, sum(valid)::BIGINT AS valid, sum(missing)::BIGINT AS missing, round(sum(valid) / sum(candidates)::DOUBLE, 7) + 0.0 AS valid_rate, round(sum(missing) / sum(candidates)::DOUBLE, 7) + 0.0 AS missing_rate FROM m GROUP BY 1, 2",
    "ic_cumulative_chart": _with(PANEL, PREDICTIONS, _DIAG) + "SELECT model, date, round(sum(ic) OVER (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumulative FROM diag",
    "ic_histogram": _with(PANEL, PREDICTIONS, _DIAG, "v AS (SELECT model, round(ic, 7) AS ic FROM diag WHERE ic IS NOT NULL)", "e AS (SELECT model, min(ic) AS lo, (max(ic) - min(ic)) / 30 AS w FROM v GROUP BY 1)", "b AS (SELECT v.model, lo, w, least(floor((ic - lo) / w), 29)::BIGINT AS bin FROM v JOIN e ON e.model = v.model)")
    + "SELECT model, bin, round(lo + bin * w, 6) + 0.0 AS low, round(lo + (bin + 1) * w, 6) + 0.0 AS high, count(*) AS n FROM b GROUP BY model, bin, lo, w",
    "group_wealth_chart": _with(PANEL, PREDICTIONS, _DESC, _GR) + "SELECT model, grp::BIGINT AS grp, date_trunc('quarter', date)::DATE AS date, round(avg(1 + daily_return), 6) + 0.0 AS nav, count(DISTINCT path) AS paths, round(avg(1 + daily_return) - 1, 6) + 0.0 AS cumulative_return FROM gr WHERE grp IN (1, 3, 5) GROUP BY 1, 2, 3",
    "group_return_bars": f"SELECT series, round(pow(product(1 + net), 12.0 / count(*)) - 1, 5) + 0.0 AS annual_return FROM ({_BACKTEST}) WHERE series LIKE 'group%' GROUP BY 1",
    "wealth_comparison": f"SELECT date, CASE series WHEN 'group_5' THEN 'long' WHEN 'group_1' THEN 'short' ELSE series END AS leg, nav FROM ({_BACKTEST}) WHERE series IN ('group_1', 'group_5', 'long_short')",
    "prediction_scatter": _with(PANEL, PREDICTIONS) + "SELECT model, stock_code, date, round(prediction, 7) + 0.0 AS prediction, round(label, 7) + 0.0 AS label FROM predictions WHERE prediction IS NOT NULL AND label IS NOT NULL ORDER BY md5('7:' || model || ':' || stock_code || ':' || date), model, stock_code, date LIMIT 200",
    "annual_chart": f"SELECT * FROM ({_YEARS}) WHERE portfolio IN (1, 5) AND period <> 'all'",
    "resource_chart": "SELECT p_partkey AS model, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 10 ELSE p_partkey * 7 END AS display_memory_bytes, CASE WHEN p_partkey % 3 = 0 THEN 'device' ELSE 'process' END AS display_memory_scope, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 2 = 0 THEN 'sparse' ELSE 'dense' END AS wiring FROM part",
    "reported_deviation": f"""WITH m AS ({_OVER}), r AS (SELECT model, portfolio, CASE period WHEN '1995' THEN '2095' ELSE period END AS period, portfolio / 10.0::DOUBLE AS a, portfolio / 20.0::DOUBLE AS w FROM m)
SELECT r.model, r.portfolio, r.period, CASE WHEN r.portfolio IN (1, 5) THEN 'R' || r.portfolio END AS element_id, round(a, 5) + 0.0 AS report_annual_return, m.annual_return, round(m.annual_return - a, 5) + 0.0 AS annual_return_deviation, round(w, 5) + 0.0 AS report_win_rate, m.win_rate, round(m.win_rate - w, 5) + 0.0 AS win_rate_deviation
FROM r LEFT JOIN m ON m.model = r.model AND m.portfolio = r.portfolio AND m.period = r.period""",
}
