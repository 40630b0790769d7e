"""Queries of tolerance decisions, state, text tables, models and bonds, with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_income as fi
from ..functions import markdown as md
from ..operators import features as ft
from ..operators import learning as lr
from ..plans import state, verification as vf
from ..sources import market
from ..sources import synthetic as syn
from .cross_section import _r, _with
from .data import SEGMENTS

STANDARDS = [
    ("factor", None, "k0", 0.2, None, True, False, False), ("factor", None, "k1", 0.15, 1000.0, False, False, False), ("factor", None, "k2", None, None, False, True, False),
    ("factor", None, "default", 0.1, None, False, False, False), ("ml", "data", "any", 0.05, None, False, False, False), ("ml", "model", "any", None, None, False, False, True),
]
SCHEMA = "type string, layer string, key string, max_rel_dev double, abs_eps double, require_same_sign boolean, order_of_magnitude_only boolean, direction_only boolean"


def metrics_document(spark, d) -> DataFrame:
    """Part prices against perturbed copies, with every kind of rule."""
    p, k = syn.table(spark, d, "part"), F.col("p_partkey")
    report = F.when(k % 97 == 0, 0.0).when(k % 23 == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice"))
    made = F.when(k % 101 == 0, None).when(k % 31 == 0, -report).when(k % 29 == 0, report * 20).otherwise(report * (1 + ((k * 37) % 41 - 20) / 100))
    level = F.when(k % 13 == 0, "directional").when(k % 17 == 0, "magnitude").when(k % 19 == 0, "unverifiable").when(k % 2 == 0, "full")
    linked = F.when(k % 3 == 0, "assumption_linked").when(k % 7 == 0, "accepted")
    return p.select(
        k.alias("id"), F.when(k % 5 == 0, "ml").otherwise("factor").alias("type"), F.when(k % 5 == 0, F.when(k % 10 == 0, "model").otherwise("data")).alias("layer"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("key"),
        F.lit(None).cast("string").alias("tolerance_key"), report.alias("report_value"), made.alias("reproduced_value"), level.alias("verification_level"), linked.alias("attribution_status"),
    )


def _decided(spark, d) -> DataFrame:
    return vf.decide(vf.lookup_tolerance(metrics_document(spark, d), spark.createDataFrame(STANDARDS, SCHEMA)))


def tolerance_lookup(spark, d):
    return vf.lookup_tolerance(metrics_document(spark, d), spark.createDataFrame(STANDARDS, SCHEMA)).select("id", "type", "key", "max_rel_dev", "abs_eps", "require_same_sign", "order_of_magnitude_only", "direction_only")


def tolerance_recalc(spark, d):
    return _decided(spark, d).select("id", "passed", "reason")


def tolerance_overall(spark, d):
    return vf.overall(_decided(spark, d))


def metric_attribution_gaps(spark, d):
    return vf.attribution_gaps(_decided(spark, d)).select("id", "reason")


def oos_decision(spark, d):
    a = syn.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("sharpe_in"), ((F.col("c_acctbal") * (F.col("c_custkey") % 7 - 1)) / 4000).alias("sharpe_out"), (F.col("c_custkey") % 200).alias("days"))
    return vf.out_of_sample_verdict(a).select("id", "conclusion")


def state_fold(spark, d):
    e = syn.table(spark, d, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 4).alias("stage"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), "ts", "event_id")
    return state.fold(e).select("case_id", "stage", "status", "attempts")


def next_case_id(spark, d):
    ids = syn.table(spark, d, "supplier").select(F.format_string("r%03d_case", "s_suppkey").alias("case_id"))  # three digits at least
    return state.next_number(ids)


def markdown_rows(spark, d):
    text = syn.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^(.*\|.*)$", "| $1 |").alias("text"))
    return md.table_rows(text, "text", ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("cells").cast("long").alias("n_cells"))


def html_table_rows(spark, d):
    """Lines with pipes, put into an HTML table of their document and read out again."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[^<>]*\|[^<>]*$"))
    rows = F.transform(lines, lambda x: F.concat(F.lit("<tr><td>"), F.replace(F.trim(x), F.lit(" | "), F.lit("</td><td>")), F.lit("</td></tr>")))
    made = syn.table(spark, d, "documents").select("doc_id", F.concat(F.lit("<p>x</p><table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
    out = market.markdown_table(market.html_tables(made, "html", ["doc_id"]), ["doc_id"])
    return out.select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), "line")


def text_pages(spark, d):
    rows = market.pages_of_text(syn.table(spark, d, "documents"), "text", ["doc_id"], "\n")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.max(F.length("page_text")).cast("long").alias("longest"))


def _windows(spark, d) -> DataFrame:
    p = syn.panel(spark, d).withColumn("f2", F.col("fwd") * 0.5)
    rows = ft.window_index(p, syn.calendar(spark, d), ["factor", "fwd"], 4)
    rows = ft.window_tensor(rows, ["factor", "f2"], 4)
    split = F.when(F.col("date") <= F.lit(SEGMENTS[0].end), "train").when(F.col("date") <= F.lit(SEGMENTS[1].end), "valid").otherwise("test")
    return rows.select("stock_code", "date", "window", F.col("fwd").alias("label"), split.alias("split"))


def _trained(windows: DataFrame, epochs: int) -> DataFrame:
    return lr.train_models(windows, lr.KINDS, lr.TrainingSettings(hidden=4, epochs=epochs, steps=2, rate=0.03))


def model_predict(spark, d):
    windows = _windows(spark, d)
    return lr.predict(windows, lr.loaded(_trained(windows, 2)), ["stock_code", "date"]).select("stock_code", "date", "model", _r("prediction", 6))


def model_training(spark, d):
    return lr.history(_trained(_windows(spark, d), 4)).select("model", "epoch", _r("train_loss", 6), _r("valid_loss", 6))


def gradient_importance(spark, d):
    windows = _windows(spark, d)
    return lr.gradient_importance(windows, lr.loaded(_trained(windows, 2)), ["factor", "f2"]).select("model", "feature", _r("importance", 6))


def ode_euler(spark, d):
    x = lr.euler(F.col("s_acctbal") / 1000, [float(t) for t in np.arange(0, 1.01, 0.125)], lambda t, x: -x * 0.5 + t)
    return syn.table(spark, d, "supplier").select("s_suppkey", F.round(F.element_at(x, -1), 7).alias("x_end"))


def bond_analytics(spark, d):
    p = syn.table(spark, d, "part")
    face, coupon, years, rate = F.lit(100.0), (F.col("p_partkey") % 9) / 100, ((F.col("p_size") % 10) + 1).cast("double"), 0.01 + (F.col("p_partkey") % 7) / 100
    price = fi.price(face, coupon, years, rate)
    return p.select("p_partkey", F.round(price, 6).alias("price"), F.round(fi.macaulay_duration(face, coupon, years, rate), 6).alias("duration"), F.round(fi.convexity(face, coupon, years, rate), 5).alias("convexity"), F.round(fi.interpolate_curve(years, [1, 5, 10], [0.01, 0.02, 0.03]), 6).alias("curve"))


def bond_yield(spark, d):
    """Every part's yield, found again from its price."""
    p = syn.table(spark, d, "part")
    face, coupon, years, rate = F.lit(100.0), (F.col("p_partkey") % 9) / 100, ((F.col("p_size") % 10) + 1).cast("double"), 0.01 + (F.col("p_partkey") % 7) / 100
    rows = p.select("p_partkey", coupon.alias("c"), years.alias("y"), F.round(rate, 6).alias("given"), fi.price(face, coupon, years, rate).alias("price"))
    return rows.select("p_partkey", "given", F.round(fi.yield_to_maturity(F.col("price"), face, F.col("c"), F.col("y")), 6).alias("found"))


QUERIES = {f.__name__: f for f in (tolerance_lookup, tolerance_recalc, tolerance_overall, metric_attribution_gaps, oos_decision, state_fold, next_case_id, markdown_rows, html_table_rows, text_pages, model_predict, model_training, gradient_importance, ode_euler, bond_analytics, bond_yield)}

_DOC = """doc AS (SELECT id, type, layer, key, report AS a, CASE WHEN id % 101 = 0 THEN NULL WHEN id % 31 = 0 THEN -report WHEN id % 29 = 0 THEN report * 20 ELSE report * (1 + ((id * 37) % 41 - 20) / 100.0::DOUBLE) END AS b, level, linked FROM (
 SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'ml' ELSE 'factor' END AS type, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 10 = 0 THEN 'model' ELSE 'data' END END AS layer, 'k' || (p_partkey % 5) AS key,
  CASE WHEN p_partkey % 97 = 0 THEN 0 WHEN p_partkey % 23 = 0 THEN -p_retailprice ELSE p_retailprice END AS report,
  CASE WHEN p_partkey % 13 = 0 THEN 'directional' WHEN p_partkey % 17 = 0 THEN 'magnitude' WHEN p_partkey % 19 = 0 THEN 'unverifiable' ELSE 'full' END AS level,
  CASE WHEN p_partkey % 3 = 0 THEN 'assumption_linked' WHEN p_partkey % 7 = 0 THEN 'accepted' END AS linked FROM part))"""
_TOL = """tol AS (SELECT *, CASE WHEN type = 'ml' THEN CASE layer WHEN 'data' THEN 0.05::DOUBLE END ELSE CASE key WHEN 'k0' THEN 0.2::DOUBLE WHEN 'k1' THEN 0.15::DOUBLE WHEN 'k2' THEN NULL ELSE 0.1::DOUBLE END END AS rel,
 CASE WHEN type = 'factor' AND key = 'k1' THEN 1000.0::DOUBLE END AS eps, type = 'factor' AND key = 'k0' AS same, type = 'factor' AND key = 'k2' AS mag, type = 'ml' AND layer = 'model' AS dir FROM doc)"""
_MAGNITUDE = "coalesce(abs(b / nullif(a, 0)) BETWEEN 0.1 AND 10, a = 0 AND b = 0)"
_DECIDED = f"""dec AS (SELECT id, type, linked, CASE WHEN level <> 'full' AND coalesce(linked, '') <> 'assumption_linked' THEN 'level_without_assumption' WHEN level = 'unverifiable' THEN 'unverifiable' WHEN b IS NULL THEN 'not_numeric'
 WHEN level = 'directional' THEN 'directional' WHEN level = 'magnitude' THEN 'magnitude' WHEN dir THEN 'direction_only' WHEN eps IS NOT NULL AND abs(a) < eps THEN 'near_zero' WHEN same AND a * b < 0 THEN 'opposite_sign' WHEN mag THEN 'order_of_magnitude'
 WHEN a = 0 THEN 'zero_report' WHEN rel IS NULL THEN 'no_tolerance' ELSE 'relative' END AS reason, a, b, rel, eps FROM tol),
fin AS (SELECT id, type, linked, reason, CASE reason WHEN 'level_without_assumption' THEN false WHEN 'unverifiable' THEN NULL WHEN 'not_numeric' THEN false WHEN 'directional' THEN a * b > 0 OR (a = 0 AND b = 0) WHEN 'magnitude' THEN {_MAGNITUDE}
 WHEN 'direction_only' THEN a * b >= 0 WHEN 'near_zero' THEN abs(b - a) <= eps WHEN 'opposite_sign' THEN false WHEN 'order_of_magnitude' THEN {_MAGNITUDE} WHEN 'zero_report' THEN b = 0 WHEN 'no_tolerance' THEN NULL ELSE abs(b - a) / abs(a) <= rel END AS passed FROM dec)"""
_BOND = """b AS (SELECT p_partkey, (p_partkey % 9) / 100.0::DOUBLE AS c, (p_size % 10) + 1 AS y, 0.01::DOUBLE + (p_partkey % 7) / 100.0::DOUBLE AS r FROM part),
f AS (SELECT p_partkey, y, r, k::DOUBLE AS k, pow(1 + r / 2, -k) AS df, 100 * c / 2 + CASE WHEN k = 2 * y THEN 100 ELSE 0 END AS pay FROM b, (SELECT unnest(range(1, 21)) AS k) WHERE k <= 2 * y)"""

ORACLE_SQL = {
    "tolerance_lookup": _with(_DOC, _TOL) + "SELECT id, type, key, rel AS max_rel_dev, eps AS abs_eps, same AS require_same_sign, mag AS order_of_magnitude_only, dir AS direction_only FROM tol",
    "tolerance_recalc": _with(_DOC, _TOL, _DECIDED) + "SELECT id, passed, reason FROM fin",
    "tolerance_overall": _with(_DOC, _TOL, _DECIDED) + "SELECT type, count(*) AS total, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed_count, CAST(sum(CASE WHEN passed IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undecided, coalesce(bool_and(passed), false) AS all_passed FROM fin GROUP BY 1",
    "metric_attribution_gaps": _with(_DOC, _TOL, _DECIDED) + "SELECT id, reason FROM fin WHERE NOT passed AND linked IS NULL",
    "oos_decision": "SELECT c_custkey AS id, CASE WHEN c_custkey % 200 < 60 THEN 'insufficient_data' WHEN (c_acctbal / 1000) * (c_acctbal * (c_custkey % 7 - 1) / 4000) < 0 THEN 'failed' WHEN abs(c_acctbal * (c_custkey % 7 - 1) / 4000) >= 0.5 * abs(c_acctbal / 1000) THEN 'continues' ELSE 'decayed' END AS conclusion FROM customer",
    "state_fold": """SELECT user_id AS case_id, event_id % 4 AS stage, CASE arg_max(event_type, (ts, event_id)) WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, count(*) FILTER (WHERE event_type = 'click') AS attempts FROM events GROUP BY 1, 2""",
    "next_case_id": "SELECT CAST(max(s_suppkey) + 1 AS BIGINT) AS next_number FROM supplier",
    "markdown_rows": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no, len(string_split(x, '|')) AS n_cells FROM l WHERE contains(x, '|') AND NOT regexp_full_match(x, '[\s:|-]+')""",
    "html_table_rows": r"""WITH l AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_full_match(x, '[^<>\n]*\|[^<>\n]*')] AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS row_no FROM l)
SELECT doc_id, CAST(0 AS BIGINT) AS table_no, row_no, '| ' || array_to_string([replace(trim(c), '|', '\|') FOR c IN string_split(trim(x), ' | ')], ' | ') || ' |' AS line FROM u""",
    "text_pages": """SELECT doc_id, count(*) AS pages, max(length(p)) AS longest FROM (SELECT doc_id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) AND length(text) > 0 THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS p FROM documents) GROUP BY 1""",
    "ode_euler": "SELECT s_suppkey, round(list_reduce(list_prepend(s_acctbal / 1000, [i * 0.125::DOUBLE FOR i IN range(0, 8)]), lambda x, t: x + 0.125::DOUBLE * (-x * 0.5 + t)), 7) AS x_end FROM supplier",
    "bond_analytics": _with(_BOND, "s AS (SELECT p_partkey, any_value(y) AS y, sum(pay * df) AS price, sum(k / 2 * pay * df) AS d, sum(k * (k + 1) * pay * pow(1 + r / 2, -k - 2)) / 4 AS c FROM f GROUP BY 1)")
    + "SELECT p_partkey, round(price, 6) AS price, round(d / price, 6) AS duration, round(c / price, 5) AS convexity, round(CASE WHEN y <= 1 THEN 0.01 WHEN y <= 5 THEN 0.01 + 0.01 * (y - 1) / 4 WHEN y <= 10 THEN 0.02 + 0.01 * (y - 5) / 5 ELSE 0.03 END::DOUBLE, 6) AS curve FROM s",
    "bond_yield": "SELECT p_partkey, round(0.01::DOUBLE + (p_partkey % 7) / 100.0::DOUBLE, 6) AS given, round(0.01::DOUBLE + (p_partkey % 7) / 100.0::DOUBLE, 6) AS found FROM part",
}
