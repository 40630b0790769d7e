"""Content gates over parsed documents: each check is a predicate, each gate a table of case, check_id and passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.markdown import front_matter_values
from .graph import never_free
from .verification import fresh

#: Fixed values of the documents' formats.
ELEMENTS = "D|F|B|R|SA"
PAGE_MARK = r"(?m)^===== PAGE \d+ =====$"
PAGE_FIELD, QUOTE_FIELD, EXHIBITS = "页码", "原文", "图表登记"
NOT_FOUND = r"(?im)^.*判定[:：]\s*not_?found"
PLACEHOLDER, COMPARISON = "[verify 后填]", "指标对比总表"
SECTIONS = ["结论", "指标对比", "假设登记簿", "迭代历史", "审计回应", "残余偏差", "未复现清单", "复跑指引"]
OUT_OF_SAMPLE_SECTION, TRANSPLANT_SECTION = "样本外", "市场迁移"
OPEN_STATES, EXCLUDED_STATES = ("pending", "in_progress"), ("skipped", "infeasible")
LEAST_HTML = 5 * 1024
ROUND_FILES = ("diagnosis.md", "changes.md", "comparison.json")
ENDS_ITERATION = r"结论[:：]\s*[*_`]*(stop_partial|blocked)\b"
EXCLUDED_HYPOTHESES = "已排除假设"
SPEC_FIELDS = ("report_name", "title", "institution", "report_date", "authors", "market", "pdf_pages", "exhibit_declared", "element_counts", "type_hint", "tags_hint")
MAY_BE_EMPTY = ("tags_hint",)
LEAST_MILESTONES = {"easy": 1, "medium": 2, "hard": 3}
FINDING = "CDX-"
RESPONSE_COLUMNS = {"severity": "severity", "recheck": "复核", "disposition": "处置"}
RUN_LOG, RUN_SUCCEEDED = "run_log.md", "exit=0"
LEAST_CHART = 15 * 1024
CHECKED_PRIORITIES = ("core", "support")


def checks(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, check_id, passed: a row for each rule; a rule that can't be decided fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("check_id"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()])
    return df.select(key, F.explode(rows).alias("_check")).select(key, "_check.*")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def page_marks(text: Column) -> Column:
    return F.size(matches(text, PAGE_MARK))


def init_gate(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: text of the report, pdf_pages."""
    marks = page_marks(F.col("text"))
    return checks(cases, key, {"text_exists": F.col("text").isNotNull(), "page_marks": marks >= 1, "pages_agree": marks == F.col("pdf_pages")})


def declared(head: Column, name: str) -> Column:
    """The lines below `name:` in front matter, or what stands behind it."""
    return F.regexp_extract(head, rf"(?s)(?:\A|\n){name}:(.*?)(?=\n\S|\z)", 1)


def number_of(part: Column, name: str) -> Column:
    return F.regexp_extract(part, rf"\b{name}\s*:\s*(\d+)", 1).try_cast("int")


def extract_gate(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: spec and coverage_matrix, both Markdown; the spec begins with front matter."""
    head = F.regexp_extract("spec", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    body = F.regexp_replace("spec", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    counts, exhibits = declared(F.col("_head"), "element_counts"), declared(F.col("_head"), "exhibit_declared")
    parts = F.split(F.concat(F.lit("\n"), F.col("_body")), r"\n(?=### \[)")
    blocks = F.filter(parts, lambda b: b.rlike(rf"\A### \[(?:{ELEMENTS})\d+(?:\.\d+)?\]"))
    cases = cases.withColumns({"_head": head, "_body": body}).withColumn("_blocks", blocks)
    headings = F.size(matches(F.col("_body"), rf"(?m)^### \[(?:{ELEMENTS})\d+(?:\.\d+)?\]"))
    total = F.aggregate(F.transform(matches(counts, rf"\b(?:{ELEMENTS})\s*:\s*(\d+)", 1), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)
    rows = F.size(matches(F.col("coverage_matrix"), rf"(?m)^\|\s*(?:{ELEMENTS})\d+(?:\.\d+)?\s*\|"))
    listed = F.regexp_extract("_body", rf"(?s)(?:\A|\n)## {EXHIBITS}[^\n]*\n(.*?)(?=\n## |\z)", 1)
    figures, tables = (F.transform(matches(listed, rf"(?m)^\|\s*(?:{p})(\d+)\s*\|", 1), lambda x: x.cast("int")) for p in ("FIG|EX", "TBL"))
    same = lambda xs, n: F.coalesce(F.size(xs) == n, F.lit(True))
    upto = lambda xs, n: F.coalesce(F.coalesce(F.array_max(xs), F.lit(0)) <= n, F.lit(True))
    return checks(
        cases, key,
        {
            "front_matter": F.length("_head") > 0,
            "counts_agree": (headings == total) & (headings == rows),
            "blocks_have_evidence": F.forall("_blocks", lambda b: b.rlike(rf"(?m)^- {PAGE_FIELD}[:：]") & b.rlike(rf"(?m)^- {QUOTE_FIELD}[:：]")),
            "has_result": F.exists("_blocks", lambda b: b.rlike(r"\A### \[R\d")),
            "exhibits_agree": same(figures, number_of(counts, "FIG_registered")) & same(tables, number_of(counts, "TBL_registered")) & upto(figures, number_of(exhibits, "fig_max")) & upto(tables, number_of(exhibits, "tbl_max")),
        },
    )


def review_findings(reviews: DataFrame, text_col: str = "text", key: str = "case_id") -> DataFrame:
    """key, n_findings, verdict of reviews, one a key: those of the review's JSON if it lists findings, else of its tables.

    In tables, a row whose first cell is a finding's id is a finding, and the verdict stands after VERDICT: anywhere; null without one.
    """
    doc = F.try_parse_json(md.json_in(F.col(text_col), "findings"))
    n = F.coalesce(F.size(F.coalesce(F.try_variant_get("_doc", "$.findings", "array<variant>"), F.array().cast("array<variant>"))), F.lit(0))
    rows = reviews.select(key, text_col, doc.alias("_doc")).select(key, text_col, n.alias("_n"), F.try_variant_get("_doc", "$.verdict", "string").alias("_verdict"), F.col("_doc").isNotNull().alias("_json"))
    listed = md.table_records(rows.where("NOT _json"), text_col, [key]).where(F.get("cells", F.lit(0)).rlike(f"^{FINDING}"))
    counts = listed.groupBy(key).agg(F.count(F.lit(1)).alias("_listed"))
    said = F.nullif(F.regexp_extract(F.col(text_col), r"(?i)VERDICT:\s*(\w+)", 1), F.lit(""))
    n = F.when(F.col("_json"), F.col("_n").cast("long")).otherwise(F.coalesce("_listed", F.lit(0).cast("long")))
    return rows.join(counts, key, "left").select(key, n.alias("n_findings"), F.when(F.col("_json"), F.col("_verdict")).otherwise(said).alias("verdict"))


def audit_responses(texts: DataFrame, checkpoint: str, text_col: str = "text", key: str = "case_id") -> DataFrame:
    """key, finding_id, severity, recheck, disposition: the rows of the tables that answer findings of a checkpoint (S, C or R).

    A row answers the first of its cells that is a finding's id; what it says is found by its column's name.
    """
    rows = md.table_records(texts, text_col, [key])
    finding = F.try_element_at(F.filter("cells", lambda c: c.rlike(rf"^{FINDING}[A-Z]-")), F.lit(1))
    rows = rows.withColumn("finding_id", finding).where(F.col("finding_id").startswith(f"{FINDING}{checkpoint}-"))
    return rows.select(key, "finding_id", *[md.cell(name).alias(c) for c, name in RESPONSE_COLUMNS.items()])


def audit_gate(cases: DataFrame, findings: DataFrame, responses: DataFrame, diffs: DataFrame | None = None, key: str = "case_id") -> DataFrame:
    """findings: key; responses: key, severity, recheck, disposition; diffs: key, ruling (of a blind second extraction)."""
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    is_ = lambda c, v: F.coalesce(F.lower(F.col(c)) == v, F.lit(False))
    issues = findings.groupBy(key).agg(F.count(F.lit(1)).alias("_issues"))
    answers = responses.groupBy(key).agg(
        F.count(F.lit(1)).alias("_answers"),
        F.count_if(is_("severity", "critical") & ~is_("recheck", "pass")).alias("_open"),
        F.count_if(is_("severity", "major") & ~filled("disposition")).alias("_unanswered"),
    )
    rows = cases.select(key).join(issues, key, "left").join(answers, key, "left").fillna(0, ["_issues", "_answers", "_open", "_unanswered"])
    rules = {"all_answered": F.col("_answers") == F.col("_issues"), "no_open_critical": F.col("_open") == 0, "majors_answered": F.col("_unanswered") == 0}
    if diffs is not None:
        rows = rows.join(diffs.groupBy(key).agg(F.count_if(~filled("ruling")).alias("_unruled")), key, "left")
        rules = {"diffs_ruled": F.col("_unruled") == 0} | rules
    return checks(rows, key, rules)


def external_name(has_new: Column, has_old: Column, new: str, old: str) -> Column:
    """The file to read: the new name, unless only the old one is there."""
    return F.when(~has_new & has_old, F.lit(old)).otherwise(F.lit(new))


def code_audit_gate(cases: DataFrame, audits: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: difficulty, tags; audits: key, text. Hard or learned cases need an audit, and none may say not found."""
    own = audits.groupBy(key).agg(F.count(F.lit(1)).alias("_audits"), F.count_if(F.col("text").rlike(NOT_FOUND)).alias("_empty"))
    rows = cases.join(own, key, "left").fillna(0, ["_audits", "_empty"])
    needed = (F.coalesce("difficulty", F.lit("medium")) != "easy") | F.coalesce(F.array_contains("tags", "ml"), F.lit(False))
    return checks(rows, key, {"audited": ~needed | (F.col("_audits") > 0), "nothing_missing": F.col("_empty") == 0})


def implement_gate(cases: DataFrame, milestones: DataFrame, matrix: DataFrame, key: str = "case_id") -> DataFrame:
    """milestones: key, implement; matrix: key, state, location."""
    undone = milestones.groupBy(key).agg(F.count_if(~F.coalesce(F.col("implement") == "done", F.lit(False))).alias("_undone"))
    nowhere = F.length(F.trim(F.coalesce("location", F.lit("")))) == 0
    unplaced = matrix.groupBy(key).agg(F.count_if(~F.coalesce(F.col("state").isin(*EXCLUDED_STATES), F.lit(False)) & nowhere).alias("_unplaced"))
    rows = cases.select(key).join(undone, key, "left").join(unplaced, key, "left").fillna(0, ["_undone", "_unplaced"])
    return checks(rows, key, {"milestones_done": F.col("_undone") == 0, "elements_placed": F.col("_unplaced") == 0})


def report_gate(cases: DataFrame, matrix: DataFrame, responses: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: report, assumptions, page (HTML), coverage_total, oos_done, experimental; matrix: key, state; responses: key, finding_id, disposition."""
    heads = matches(F.col("report"), r"(?m)^##\s+(.*)$", 1)
    needed = F.concat(F.array(*[F.lit(s) for s in SECTIONS]), F.when(F.col("oos_done"), F.array(F.lit(OUT_OF_SAMPLE_SECTION))).otherwise(F.array().cast("array<string>")), F.when(F.col("experimental"), F.array(F.lit(TRANSPLANT_SECTION))).otherwise(F.array().cast("array<string>")))
    waiting = matrix.groupBy(key).agg(F.count_if(F.col("state").isin(*OPEN_STATES)).alias("_open"))
    silent = responses.where("disposition = 'rejected'").select(key, "finding_id").join(cases.select(key, "report"), key).groupBy(key).agg(F.count_if(~F.contains("report", F.col("finding_id"))).alias("_silent"))
    rows = cases.join(waiting, key, "left").join(silent, key, "left").fillna(0, ["_open", "_silent"]).withColumns({"_heads": heads, "_needed": needed})
    return checks(
        rows, key,
        {
            "sections": F.forall("_needed", lambda s: F.exists("_heads", lambda h: F.contains(h, s))),
            "nothing_open": F.col("_open") == 0,
            "no_placeholder": ~F.contains("assumptions", F.lit(PLACEHOLDER)),
            "rejections_told": F.col("_silent") == 0,
            "page": F.contains("page", F.col(key).cast("string")) & F.contains("page", F.lit(COMPARISON)) & (F.octet_length("page") > LEAST_HTML),
            "coverage": F.col("coverage_total") > 0,
        },
    )


def iteration_gate(cases: DataFrame, files: DataFrame, key: str = "case_id") -> DataFrame:
    """Checks of iteration rounds, and `missing`, the sorted files that a case lacks (round/name), as rows of checks().

    cases: key, current (rounds so far), most (rounds allowed, null: any number). files: key, round, name, text.
    Every round up to the current one needs all ROUND_FILES, a relational division; a round whose
    diagnosis ends the iteration needs no changes. From the second round on a diagnosis names excluded hypotheses.
    """
    rounds = cases.select(key, F.explode(F.when(F.col("current") > 0, F.sequence(F.lit(1), F.col("current").cast("int")))).alias("round"))
    said = F.when(F.col("name") == ROUND_FILES[0], F.coalesce("text", F.lit("")))
    present = files.groupBy(key, F.col("round").cast("int").alias("round")).agg(
        F.collect_set(F.when(F.col("name").isin(*ROUND_FILES), F.col("name"))).alias("names"),
        F.coalesce(F.bool_or(said.rlike(ENDS_ITERATION)), F.lit(False)).alias("over"),
        F.coalesce(F.bool_or(said.contains(EXCLUDED_HYPOTHESES)), F.lit(False)).alias("excludes"),
    )
    rows = rounds.join(present, [key, "round"], "left")
    wanted = F.array(*[F.lit(n) for n in ROUND_FILES])
    wanted = F.when(F.col("over"), F.array_remove(wanted, F.lit(ROUND_FILES[1]))).otherwise(wanted)
    lacking = F.array_except(wanted, F.coalesce("names", F.array().cast("array<string>")))
    rows = rows.select(key, F.transform(lacking, lambda n: F.concat(F.col("round").cast("string"), F.lit("/"), n)).alias("lacking"), ((F.col("round") > 1) & ~F.coalesce("excludes", F.lit(False))).alias("silent"))
    found = rows.groupBy(key).agg(F.flatten(F.collect_list("lacking")).alias("lacking"), F.bool_or("silent").alias("silent"))
    whole = cases.join(found, key, "left").withColumn("lacking", F.coalesce("lacking", F.array().cast("array<string>")))
    rules = {"round_files": F.size("lacking") == 0, "rounds_allowed": F.col("most").isNull() | (F.coalesce("current", F.lit(0)) <= F.col("most")), "excluded_hypotheses": ~F.coalesce("silent", F.lit(False))}
    rows = F.array(*[F.struct(F.lit(n).alias("check_id"), F.coalesce(c, F.lit(False)).alias("passed"), F.when(F.lit(n == "round_files"), F.array_join(F.sort_array("lacking"), ",")).otherwise("").alias("missing")) for n, c in rules.items()])
    return whole.select(key, F.explode(rows).alias("_check")).select(key, "_check.*")


def spec_fields(cases: DataFrame, key: str = "case_id", text_col: str = "spec") -> DataFrame:
    """key, field, problem (missing or empty): fields of the front matter that a specification must have and fill.

    Zero, false, null, blank text and lists or maps without items are empty. A text without front matter lacks all fields.
    """
    top = front_matter_values(cases, text_col, [key]).where(~F.contains("path", F.lit(".")) & ~F.contains("path", F.lit("[")))
    unfilled = (F.col("kind") == "null") | (F.col("kind").isin("map", "list") & (F.col("value") == "0")) | (F.col("kind").isin("number", "string") & (F.coalesce(F.trim("value"), F.lit("")) == "")) | ((F.col("kind") == "number") & (F.col("value").try_cast("double") == 0)) | ((F.col("kind") == "boolean") & (F.col("value") == "false"))
    found = top.select(key, F.col("path").alias("field"), unfilled.alias("_empty"))
    needed = cases.select(key, F.explode(F.array(*map(F.lit, SPEC_FIELDS))).alias("field"))
    problem = F.when(F.col("_empty").isNull(), "missing").when(F.col("_empty") & ~F.col("field").isin(*MAY_BE_EMPTY), "empty")
    return needed.join(found, [key, "field"], "left").select(key, "field", problem.alias("problem")).where("problem IS NOT NULL")


def plan_gate(cases: DataFrame, milestones: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: key, difficulty (null: medium); milestones: key, id, deps. An easy plan has a milestone at least, a hard one three."""
    counts = milestones.where("id IS NOT NULL").groupBy(key).agg(F.count_distinct("id").alias("_n"))
    stuck = never_free(milestones, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("_stuck"))
    rows = cases.select(key, F.coalesce("difficulty", F.lit("medium")).alias("_level")).join(counts, key, "left").join(stuck, key, "left").fillna(0, ["_n", "_stuck"])
    least = F.coalesce(*[F.when(F.col("_level") == level, n) for level, n in LEAST_MILESTONES.items()])
    return checks(rows, key, {"enough_milestones": F.col("_n") >= least, "acyclic": F.col("_stuck") == 0})


def verify_gate(cases: DataFrame, files: DataFrame, logs: DataFrame, decided: DataFrame, matrix: DataFrame, key: str = "case_id") -> DataFrame:
    """Checks of a verification, from the listing of its files and the content of its log alone.

    cases: key, charts, workbooks (arrays of the names that its type needs; null: none); files: key, kind (source or output),
    name, path, modified, length; logs: key, text of RUN_LOG; decided: key, passed (null: waived) of each metric;
    matrix: key, state, priority, verified.
    """
    outputs = files.where("kind = 'output'")
    named = lambda sort: F.transform(F.coalesce(sort, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(sort).alias("sort")))
    needed = cases.select(key, F.explode(F.concat(named("charts"), named("workbooks"))).alias("_x")).select(key, "_x.*")
    sizes = outputs.groupBy(key, "name").agg(F.max("length").alias("length"))
    small = F.coalesce("length", F.lit(-1)) <= F.when(F.col("sort") == "charts", LEAST_CHART).otherwise(0)
    short = needed.distinct().join(sizes, [key, "name"], "left").groupBy(key).agg(F.count_if(small & (F.col("sort") == "charts")).alias("_charts"), F.count_if(small & (F.col("sort") == "workbooks")).alias("_workbooks"))
    ran = logs.groupBy(key).agg(F.bool_or(F.contains("text", F.lit(RUN_SUCCEEDED))).alias("_ran"))
    metrics = decided.groupBy(key).agg(F.bool_and(F.coalesce("passed", F.lit(True))).alias("_metrics"))
    said = F.length(F.trim(F.coalesce("verified", F.lit("")))) > 0
    counted = F.col("priority").isin(*CHECKED_PRIORITIES) & ~F.coalesce(F.col("state").isin(*EXCLUDED_STATES), F.lit(False))
    silent = matrix.groupBy(key).agg(F.count_if(counted & ~said).alias("_silent"))
    rows = cases.select(key)
    for part in (short, ran, metrics, silent, fresh(files, [key]).select(key, F.col("passed").alias("_fresh"))):
        rows = rows.join(part, key, "left")
    rows = rows.fillna(0, ["_charts", "_workbooks", "_silent"])
    return checks(rows, key, {"run_log": F.col("_ran"), "metrics": F.col("_metrics"), "charts": F.col("_charts") == 0, "workbooks": F.col("_workbooks") == 0, "fresh": F.col("_fresh"), "matrix_verified": F.col("_silent") == 0})
