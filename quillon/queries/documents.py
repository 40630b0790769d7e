"""Queries of dependency graphs, nested front matter, files as rows and checks of documents, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators import validate
from ..plans import gates, state
from ..plans import verification as vf
from ..plans.graph import never_free
from ..sources import files, paged
from ..sources import synthetic as syn
from ..sources.scratch import folder
from .cross_section import _with
from .verification import _DOC, STANDARDS, metrics_document
from .verification import SCHEMA as STANDARD_SCHEMA


def _milestones(spark, d):
    """Lines as milestones of their order, each waiting for two by rule; some of these don't exist."""
    lines = syn.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("id"), "l_partkey", "l_suppkey", "l_quantity")
    return lines.select("case_id", "id", F.array((F.col("l_partkey") % 9).cast("long"), F.when(F.col("l_quantity") > 10, (F.col("l_suppkey") % 8).cast("long"))).alias("deps"))


def blocked_milestones(spark, d):
    return never_free(_milestones(spark, d), ["case_id"])


def gate_plan(spark, d):
    k = F.col("o_orderkey")
    cases = syn.table(spark, d, "orders").select(k.alias("case_id"), F.when(k % 3 == 0, "easy").when(k % 3 == 1, "hard").alias("difficulty"))
    return gates.plan_gate(cases, _milestones(spark, d))


def _specs(spark, d):
    """A specification for each supplier: nested front matter with gaps by rule."""
    k = F.col("s_suppkey")
    text = F.concat(
        F.when(k % 11 != 0, "---\n").otherwise(""),
        F.lit("report_name: "), F.when(k % 4 != 0, F.col("s_name")).otherwise(""), F.lit(" # as printed\ntitle: \""), F.col("s_name"), F.lit(": a, b\"\ninstitution: Desk\n"),
        F.when(k % 5 != 0, "report_date: 2020-01-02\n").otherwise(""),
        F.lit("authors:\n- name: N"), k.cast("string"), F.lit("\n  desk: [x, y]\n- name: M\nmarket: {code: M"), (k % 3).cast("string"), F.lit(", open: true}\npdf_pages: "), (k % 6).cast("string"),
        F.lit("\nexhibit_declared:\n  fig_max: "), (k % 9).cast("string"), F.lit("\nelement_counts:\n  D: "), (k % 4).cast("string"), F.lit("\n  R: 1\ntype_hint: factor\n"), F.when(k % 7 != 0, "tags_hint: []\n").otherwise(""), F.lit("---\nbody: no\n"),
    )
    return syn.table(spark, d, "supplier").select(k.alias("case_id"), text.alias("spec"))


def front_matter_nested(spark, d):
    return md.front_matter_values(_specs(spark, d), "spec", ["case_id"])


def gate_spec_fields(spark, d):
    return gates.spec_fields(_specs(spark, d))


def gate_verify(spark, d):
    """A folder of files for each supplier, written, listed and checked; every fourth one's sources are newer than its outputs."""
    k = F.col("s_suppkey")
    cases = syn.table(spark, d, "supplier").select(k.alias("case_id"), F.array(F.lit("ic.png")).alias("charts"), F.when(k % 2 == 0, F.array(F.lit("book.xlsx"))).alias("workbooks"))
    base, key = folder(spark, "cases"), F.col("case_id")
    place = lambda kind, name: F.concat(key.cast("string"), F.lit(f"/{kind}/{name}"))
    row = lambda name, text: F.struct(place("output", name).alias("path"), text.alias("text"))
    outputs = F.array(
        row("run_log.md", F.when(key % 5 == 0, "exit=1").otherwise("done, exit=0")),
        row("ic.png", F.repeat(F.lit("x"), F.when(key % 3 == 0, gates.LEAST_CHART).otherwise(gates.LEAST_CHART + 1))),
        row("book.xlsx", F.when(key % 6 == 0, "").otherwise("x")),
    )
    made = cases.select("case_id", F.explode(outputs).alias("x")).select("case_id", "x.*")
    files.write_texts(made.where("case_id % 4 = 0"), base)
    files.write_texts(cases.select(F.explode(F.array(place("source", "main.py"), place("source", "__pycache__/main.pyc"))).alias("path")).withColumn("text", F.lit("pass")), base)
    files.write_texts(made.where("case_id % 4 <> 0"), base)
    own = F.split(files.below(F.col("path"), base), "/")
    listed = files.listing(spark, base).withColumns({"case_id": own[0].cast("long"), "kind": own[1]})
    logs = files.texts(spark, base, gates.RUN_LOG).select(own[0].cast("long").alias("case_id"), "text")
    parts = syn.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("case_id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") > 905).alias("passed"))
    lines = syn.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.when(F.col("l_returnflag") == "N", "skipped").otherwise("done").alias("state"), F.when(F.col("l_linenumber") < 3, "core").otherwise("extra").alias("priority"), F.when(F.col("l_tax") > 0, "ok").alias("verified"))
    return gates.verify_gate(cases, listed, logs, parts, lines)


def gate_verdict(spark, d):
    """Lines as checks, return flags as stages."""
    lines = syn.table(spark, d, "lineitem").where("l_linenumber > 5").select(F.col("l_returnflag").alias("stage"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("check_id"), (F.col("l_tax") > 0.07).alias("passed"))
    return vf.gate(lines).select("stage", "verdict", "checks", F.size("failed").cast("long").alias("n_failed"), F.try_element_at("failed", F.lit(1)).alias("first_failed"))


def tolerance_user_max(spark, d):
    """The user's limit takes the place of every relative one; metrics without one keep none."""
    rows = vf.lookup_tolerance(metrics_document(spark, d), spark.createDataFrame(STANDARDS, STANDARD_SCHEMA), 0.01)
    return rows.select("id", "max_rel_dev", "abs_eps")


def oos_problems(spark, d):
    k = F.col("c_custkey")
    at = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    docs = syn.table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 13 != 0, at(k % 7)).alias("in_sample_end"), at(k % 5).alias("oos_start"), at(k % 6 + 2).alias("oos_end"), (k % 120).alias("oos_days"),
        F.when(k % 3 == 0, "continues").when(k % 3 == 1, "unsure").otherwise("decayed").alias("conclusion"), F.when(k % 2 == 0, "short").alias("warning"),
    )
    return vf.check_out_of_sample(docs).select("id", "passed", F.array_join("problems", ",").alias("problems"))


def state_event_problems(spark, d):
    e = F.col("event_id")
    events = syn.table(spark, d, "events").select("event_id", F.when(e % 11 != 0, F.col("user_id")).alias("case_id"), F.when(e % 13 != 0, e % 4).alias("stage"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "broken").when(F.col("event_type") == "view", "done").alias("status"), "ts")
    return state.invalid_events(events).select("event_id")


def checked_table(spark, d):
    """Orders written only if each is there once, and read again."""
    orders = syn.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return validate.write_checked(orders, folder(spark, "checked"), ["o_orderkey"], 1)


def external_files(spark, d):
    k = F.col("s_suppkey")
    return syn.table(spark, d, "supplier").select(k.alias("case_id"), gates.external_name(k % 2 == 0, k % 3 == 0, "review.md", "audit.md").alias("name"))


def answer_json(spark, d):
    """Answers that are JSON, hold it in a block, or have it stand in prose; some have none."""
    k = F.col("s_suppkey")
    doc = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "note": "a } b", "in": {"x": [1, {"y": 2}]}}'))
    text = F.when(k % 4 == 0, doc).when(k % 4 == 1, F.concat(F.lit("So:\n```json\n"), doc, F.lit("\n```\nEnd {}"))).when(k % 4 == 2, F.concat(F.lit("First {not json} then "), doc, F.lit(" and {no more"))).otherwise("nothing here")
    return syn.table(spark, d, "supplier").select(k.alias("case_id"), F.get_json_object(md.json_in(text), "$.id").cast("long").alias("id"), F.get_json_object(md.json_in(text), "$.in.x[1].y").cast("long").alias("y"))


def paged_files(spark, d):
    """Documents as files of pages with counts that are one too low, right, one too high or not given; pages from the second on."""
    k, base, counts = F.col("doc_id"), folder(spark, "paged"), folder(spark, "page_counts")
    docs = syn.table(spark, d, "documents").select("doc_id", F.concat(k.cast("string"), F.lit(".txt")).alias("path"), F.translate("text", "\n", "\f").alias("text"))
    files.write_texts(docs, base)
    found = F.size(F.split(F.regexp_replace("text", r"[ \t-\r]+\z", ""), "\f"))
    docs.where(k % 4 < 3).select(F.col("path").alias("file"), (found + (k % 4 - 1)).cast("int").alias("pages")).write.parquet(counts)
    rows = paged.pages(spark, base, counts, pages_per_task=64).where("page > 1")
    return rows.select(F.substring_index("file", ".", 1).cast("long").alias("doc_id"), "page", F.md5("page_text").alias("page_md5"))


def state_appended(spark, d):
    """Events that come in three batches, the last one with the first one's again: folded as they come."""
    e = syn.table(spark, d, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 4).alias("stage"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), "ts", "event_id")
    source, target = folder(spark, "event_log"), folder(spark, "case_states")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for batch in (e.where(part == 0), e.where(part == 1), e.where(part != 1)):
        batch.write.mode("append").parquet(source)
        state.fold_appended(spark.readStream.schema(e.schema).parquet(source), target)
    return state.folded(spark, target).select("case_id", "stage", "status", "attempts")


def _answered(spark, d):
    """A document for each order with a table of its lines, between a table of another kind and lines that are no table."""
    n = F.col("l_linenumber")
    row = F.concat(
        F.lit("| CDX-"), F.when(n % 3 == 0, "C").otherwise("S"), F.lit("-"), n.cast("string"), F.lit(" | "), F.when(n % 3 == 0, "Critical").otherwise("major"), F.lit(" | a \\| b | "),
        F.when(F.col("l_tax") > 0.01, "fixed").otherwise(" "), F.when(F.col("l_returnflag") != "N", " | x | PASS |").otherwise(" |"),
    )
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda x: x["row"]), "\n")
    text = F.concat(F.lit("| checked | result |\n|---|---|\n| data | CDX-S-0 |\n\n| CDX-S-9 | no table |\n\nVerdict: revise\n| id | severity | what | 处置(a/b) | answer | 复核 |\n| :-- | --- | --- | --- | --- | --- |\n"), rows, F.lit("\n\nend | of | it |"))
    return syn.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(text.alias("text"), F.count(F.lit(1)).alias("n"))


def audit_answers(spark, d):
    return gates.audit_responses(_answered(spark, d), "S")


def review_results(spark, d):
    """Reviews that are JSON, hold it in a second block, or have only tables."""
    k = F.col("case_id")
    doc = F.concat(F.lit('{"verdict": "approve", "findings": ['), F.array_join(F.array_repeat(F.lit('{"id": "CDX-S-1"}'), F.col("n").cast("int")), ", "), F.lit("]}"))
    text = F.when(k % 3 == 0, doc).when(k % 3 == 1, F.concat(F.lit('```json\n{"other": 1}\n```\n```json\n'), doc, F.lit("\n```\n"), F.col("text"))).otherwise(F.col("text"))
    return gates.review_findings(_answered(spark, d).select("case_id", text.alias("text")))


QUERIES = {f.__name__: f for f in (audit_answers, review_results, paged_files, state_appended, blocked_milestones, gate_plan, front_matter_nested, gate_spec_fields, gate_verify, gate_verdict, tolerance_user_max, oos_problems, state_event_problems, checked_table, external_files, answer_json)}

_STUCK = """ms AS (SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) AS id, [CAST(l_partkey % 9 AS BIGINT), CASE WHEN l_quantity > 10 THEN CAST(l_suppkey % 8 AS BIGINT) END] AS deps FROM lineitem),
e AS (SELECT DISTINCT a.case_id, a.id, a.dep FROM (SELECT case_id, id, unnest(deps) AS dep FROM ms) a JOIN ms b ON a.case_id = b.case_id AND a.dep = b.id),
r AS (SELECT case_id, id, dep FROM e UNION SELECT r.case_id, r.id, e.dep FROM r JOIN e ON r.case_id = e.case_id AND r.dep = e.id),
stuck AS (SELECT DISTINCT r.case_id, r.id FROM r JOIN (SELECT case_id, id FROM r WHERE id = dep) c ON r.case_id = c.case_id AND (r.dep = c.id OR r.id = c.id))"""
_FIELD_PROBLEMS = {
    "report_name": "CASE WHEN k % 4 = 0 THEN 'empty' END", "report_date": "CASE WHEN k % 5 = 0 THEN 'missing' END", "pdf_pages": "CASE WHEN k % 6 = 0 THEN 'empty' END", "tags_hint": "CASE WHEN k % 7 = 0 THEN 'missing' END",
    **{f: "NULL" for f in ("title", "institution", "authors", "market", "exhibit_declared", "element_counts", "type_hint")},
}
_VALUES = [
    ("report_name", "CASE WHEN k % 4 = 0 THEN 'null' ELSE 'string' END", "CASE WHEN k % 4 <> 0 THEN s_name END"), ("title", "'string'", "s_name || ': a, b'"), ("institution", "'string'", "'Desk'"),
    ("authors", "'list'", "'2'"), ("authors[0]", "'map'", "'2'"), ("authors[0].name", "'string'", "'N' || k"), ("authors[0].desk", "'list'", "'2'"), ("authors[0].desk[0]", "'string'", "'x'"), ("authors[0].desk[1]", "'string'", "'y'"),
    ("authors[1]", "'map'", "'1'"), ("authors[1].name", "'string'", "'M'"), ("market", "'map'", "'2'"), ("market.code", "'string'", "'M' || (k % 3)"), ("market.open", "'boolean'", "'true'"), ("pdf_pages", "'number'", "CAST(k % 6 AS VARCHAR)"),
    ("exhibit_declared", "'map'", "'1'"), ("exhibit_declared.fig_max", "'number'", "CAST(k % 9 AS VARCHAR)"), ("element_counts", "'map'", "'2'"), ("element_counts.D", "'number'", "CAST(k % 4 AS VARCHAR)"), ("element_counts.R", "'number'", "'1'"),
    ("type_hint", "'string'", "'factor'"),
]
_S = "s AS (SELECT s_suppkey AS k, s_name FROM supplier)"


def _rules(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT case_id, '{n}' AS check_id, coalesce({c}, false) AS passed FROM {table}" for n, c in rules.items())


ORACLE_SQL = {
    "audit_answers": """SELECT l_orderkey AS case_id, 'CDX-S-' || l_linenumber AS finding_id, 'major' AS severity, CASE WHEN l_returnflag <> 'N' THEN 'PASS' ELSE '' END AS recheck, CASE WHEN l_tax > 0.01 THEN 'fixed' ELSE '' END AS disposition
 FROM lineitem WHERE l_linenumber % 3 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 'CDX-S-0', '', '', '' FROM lineitem""",
    "review_results": "SELECT l_orderkey AS case_id, count(*) AS n_findings, CASE WHEN l_orderkey % 3 < 2 THEN 'approve' ELSE 'revise' END AS verdict FROM lineitem GROUP BY 1",
    "paged_files": r"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents), c AS (SELECT doc_id, ps, len(string_split(regexp_replace(array_to_string(ps, chr(10)), '[ \t-\r]+$', ''), chr(10))) AS n,
 CASE WHEN regexp_matches(ps[-1], '^[ \t-\r]*$') THEN len(ps) - 1 ELSE len(ps) END AS held FROM t),
m AS (SELECT doc_id, ps[:held] AS ps, CASE WHEN doc_id % 4 < 3 THEN n + doc_id % 4 - 1 ELSE held END AS n FROM c)
SELECT doc_id, CAST(page AS INTEGER) AS page, md5(coalesce(ps[page], '')) AS page_md5 FROM (SELECT doc_id, ps, unnest(range(2, n + 1)) AS page FROM m)""",
    "state_appended": "SELECT user_id AS case_id, event_id % 4 AS stage, CASE arg_max(event_type, (ts, event_id)) WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, count(*) FILTER (WHERE event_type = 'click') AS attempts FROM events GROUP BY 1, 2",
    "blocked_milestones": "WITH RECURSIVE " + _STUCK + " SELECT case_id, id FROM stuck",
    "gate_plan": "WITH RECURSIVE " + _STUCK + """, c AS (SELECT o_orderkey AS case_id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS least, coalesce(n, 0) AS n, coalesce(t, 0) AS t FROM orders
 LEFT JOIN (SELECT case_id, count(DISTINCT id) AS n FROM ms GROUP BY 1) x ON x.case_id = o_orderkey LEFT JOIN (SELECT case_id, count(*) AS t FROM stuck GROUP BY 1) y ON y.case_id = o_orderkey)
""" + _rules("c", {"enough_milestones": "n >= least", "acyclic": "t = 0"}),
    "front_matter_nested": _with(_S) + " UNION ALL ".join(f"SELECT k AS case_id, '{p}' AS path, {kind} AS kind, {v} AS value FROM s WHERE k % 11 <> 0" for p, kind, v in _VALUES)
    + " UNION ALL SELECT k, 'report_date', 'string', '2020-01-02' FROM s WHERE k % 11 <> 0 AND k % 5 <> 0 UNION ALL SELECT k, 'tags_hint', 'list', '0' FROM s WHERE k % 11 <> 0 AND k % 7 <> 0",
    "gate_spec_fields": _with(_S, "p AS (" + " UNION ALL ".join(f"SELECT k AS case_id, '{f}' AS field, CASE WHEN k % 11 = 0 THEN 'missing' ELSE {c} END AS problem FROM s" for f, c in _FIELD_PROBLEMS.items()) + ")") + "SELECT case_id, field, problem FROM p WHERE problem IS NOT NULL",
    "gate_verify": """WITH m AS (SELECT p_partkey % 50 AS case_id, bool_and(CASE WHEN p_partkey % 3 > 0 THEN p_retailprice > 905 ELSE true END) AS ok FROM part GROUP BY 1),
x AS (SELECT l_suppkey AS case_id, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linenumber < 3 AND NOT l_tax > 0) AS silent FROM lineitem GROUP BY 1),
c AS (SELECT s_suppkey AS case_id, m.ok, coalesce(x.silent, 0) AS silent FROM supplier LEFT JOIN m ON m.case_id = s_suppkey LEFT JOIN x ON x.case_id = s_suppkey)
""" + _rules("c", {"run_log": "case_id % 5 <> 0", "metrics": "ok", "charts": "case_id % 3 <> 0", "workbooks": "case_id % 6 <> 0", "fresh": "case_id % 4 <> 0", "matrix_verified": "silent = 0"}),
    "gate_verdict": "SELECT l_returnflag AS stage, bool_and(l_tax > 0.07) AS verdict, count(*) AS checks, count(*) FILTER (WHERE NOT l_tax > 0.07) AS n_failed, min(l_orderkey || '-' || l_linenumber) FILTER (WHERE NOT l_tax > 0.07) AS first_failed FROM lineitem WHERE l_linenumber > 5 GROUP BY 1",
    "tolerance_user_max": _with(_DOC) + "SELECT id, CASE WHEN type = 'ml' THEN CASE layer WHEN 'data' THEN 0.01::DOUBLE END WHEN key = 'k2' THEN NULL ELSE 0.01::DOUBLE END AS max_rel_dev, CASE WHEN type = 'factor' AND key = 'k1' THEN 1000.0::DOUBLE END AS abs_eps FROM doc",
    "oos_problems": """WITH p AS (SELECT c_custkey AS id, [CASE WHEN c_custkey % 13 = 0 THEN 'missing_field' END, CASE WHEN (c_custkey % 13 <> 0 AND c_custkey % 5 <= c_custkey % 7) OR c_custkey % 6 + 2 < c_custkey % 5 THEN 'dates_out_of_order' END,
 CASE WHEN c_custkey % 3 = 1 THEN 'unknown_conclusion' END, CASE WHEN c_custkey % 120 < 60 AND c_custkey % 2 = 1 THEN 'short_without_warning' END] AS ps FROM customer)
SELECT id, len([x FOR x IN ps IF x IS NOT NULL]) = 0 AS passed, array_to_string([x FOR x IN ps IF x IS NOT NULL], ',') AS problems FROM p""",
    "state_event_problems": "SELECT event_id FROM events WHERE event_id % 11 = 0 OR user_id IS NULL OR event_id % 13 = 0 OR ts IS NULL OR event_type IS NULL OR event_type NOT IN ('click', 'view')",
    "checked_table": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "external_files": "SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0 THEN 'audit.md' ELSE 'review.md' END AS name FROM supplier",
    "answer_json": "SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey END AS id, CAST(CASE WHEN s_suppkey % 4 < 3 THEN 2 END AS BIGINT) AS y FROM supplier",
}
