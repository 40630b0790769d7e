"""The state of cases as a fold of an append-only event table, checks of state documents, and case ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed values of the workflow's state.
STATUSES = ("pending", "running", "done", "skipped", "blocked", "failed")


def invalid_events(events: DataFrame) -> DataFrame:
    """Events (case_id, stage, status, ts) with a missing key or an unknown status."""
    return events.where(F.col("case_id").isNull() | F.col("stage").isNull() | F.col("ts").isNull() | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def fold(events: DataFrame, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """case_id, stage, status (the last), attempts (times it ran), updated_at."""
    last = F.max(F.struct(order, tie, "status"))
    return events.groupBy("case_id", "stage").agg(last["status"].alias("status"), F.sum((F.col("status") == "running").cast("long")).alias("attempts"), F.max(order).alias("updated_at"))


def fold_appended(events: DataFrame, target: str, order: str = "ts", tie: str = "event_id") -> StreamingQuery:
    """Folds what a stream of events holds that target hasn't seen yet, and ends; `folded` reads the states.

    The query's own state keeps each event once and the fold of each (case, stage), so no event is read again. Events that are
    equal in every column of the fold count once, however often and late they come; late ones don't displace a later status.
    So the states are those of `fold` over all distinct events, whatever the batches. Each batch writes the states that it
    changed to its own folder, over what an attempt that failed may have left there. The session's state store becomes RocksDB,
    as the events seen must not have to fit in memory.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    once = events.select("case_id", "stage", "status", order, tie).dropDuplicates()

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/changes/batch={batch}")

    stream = fold(once, order, tie).writeStream.outputMode("update").option("checkpointLocation", f"{target}/_progress")
    query = stream.foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def folded(spark: SparkSession, target: str) -> DataFrame:
    """case_id, stage, status, attempts, updated_at as of the last batch of `fold_appended`."""
    changes = spark.read.parquet(f"{target}/changes")
    last = F.max_by(F.struct("status", "attempts", "updated_at"), "batch")
    return changes.groupBy("case_id", "stage").agg(last.alias("_s")).select("case_id", "stage", "_s.*")


def back_fill(states: DataFrame, stages: DataFrame, terminal: DataFrame) -> DataFrame:
    """Every stage of every case: stages without events are skipped in finished cases, else pending. terminal: case_id."""
    cases = states.select("case_id").distinct().join(terminal.select("case_id", F.lit(True).alias("_over")), "case_id", "left")
    names = [r[0] for r in stages.select("stage").collect()]  # the workflow's stages: a handful
    slots = cases.withColumn("stage", F.explode(F.array(*[F.lit(n) for n in names])))
    out = slots.join(states, ["case_id", "stage"], "left")
    status = F.coalesce("status", F.when(F.col("_over"), F.lit("skipped")).otherwise(F.lit("pending")))
    return out.select("case_id", "stage", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "updated_at")


def summary(states: DataFrame) -> DataFrame:
    return states.groupBy("case_id").agg(F.count(F.lit(1)).alias("stages"), F.sum((F.col("status") == "done").cast("long")).alias("done"), F.sum("attempts").alias("attempts"), F.max("updated_at").alias("updated_at"))


def next_number(ids: DataFrame, col: str = "case_id") -> DataFrame:
    """One above the highest number of ids like r012_name; 1 without any."""
    n = F.expr(f"try_cast(nullif(regexp_extract({col}, '^r([0-9]+)_', 1), '') AS decimal(38, 0))")
    return ids.agg((F.coalesce(F.max(n), F.lit(0)) + 1).cast("long").alias("next_number"))


def resolve(ids: DataFrame, wanted: str, col: str = "case_id") -> str:
    """The id that is wanted, or alone has its number, or alone begins with it."""
    number = F.expr(f"try_cast(nullif(regexp_extract({col}, '^r([0-9]+)_', 1), '') AS int)")
    tries = [F.col(col) == wanted]
    if wanted.removeprefix("r").isdigit():
        tries.append(number == int(wanted.removeprefix("r")))
    tries.append(F.col(col).startswith(wanted))
    for found in (ids.where(t).select(col).distinct().limit(2).collect() for t in tries):  # two show that it is ambiguous
        if len(found) == 1:
            return found[0][0]
        if found:
            raise ValueError(f"{wanted} is ambiguous")
    raise ValueError(f"{wanted} is unknown")


#: Fixed values of a state document: its fields, stages and the values that they may take.
FIELDS = (
    "schema_version", "report_id", "pdf_path", "paths", "mode", "reproduction_mode", "max_iter", "type", "tags", "difficulty", "difficulty_override", "feasibility",
    "pdf_pages", "current_stage", "status", "stages", "gates", "external_reviews", "milestones", "iteration", "verdict", "coverage_stats", "assumptions", "blockers",
    "pending_question", "events", "created_at", "updated_at",
)
STAGES = ("init", "extract", "plan", "spec_audit", "implement", "code_audit", "verify", "iterate", "result_audit", "oos", "report", "review")
MUST_BE = {
    "mode": ("auto", "interactive"),
    "reproduction_mode": ("strict", "experimental"),
    "status": ("running", "paused_blocked", "awaiting_review", "done", "done_partial", "aborted"),
    "current_stage": STAGES,
}
MAY_BE = {
    "difficulty": ("easy", "medium", "hard"),
    "difficulty_override": ("easy", "medium", "hard"),
    "type": ("factor", "timing", "allocation", "fixed_income", "ml"),
    "feasibility": ("feasible", "degraded", "blocked"),
    "verdict.result": ("pass", "partial", "fail"),
}
GATE_VERDICTS = ("PASS", "FAIL")
KIND_OF = {f: "ARRAY" for f in ("tags", "gates", "external_reviews", "milestones", "iteration.history", "blockers", "events")} | {f: "OBJECT" for f in ("stages", "iteration", "verdict", "coverage_stats", "assumptions", "paths")} | {"iteration.current": "BIGINT"}
REVIEWED = ("implement", "code_review", "verify")


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _text_at(value: Column, path: str) -> Column:
    """The string there; null for another kind."""
    return F.when(_kind(_at(value, path)) == "STRING", F.try_variant_get(value, f"$.{path}", "string"))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID or another; '' where nothing is there."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


def _keys(value: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<string>"))


def _says(problem: Column | str, wrong: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.lit(problem) if isinstance(problem, str) else problem)


def _one_of(value: Column, path: str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(_text_at(value, path).isin(*allowed), F.lit(False))


def _items(doc: Column, path: str, check) -> Column:
    """The problems of each item of an array, with its place; none where it isn't an array."""
    items = F.coalesce(F.try_variant_get(doc, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.array_compact(F.array(*check(x))), lambda p: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]."), p))))


def _gate(x: Column) -> list[Column]:
    whole = F.size(F.array_except(F.array(*map(F.lit, ("stage", "checks", "verdict", "timestamp"))), _keys(x))) == 0
    return [_says("fields", ~whole), _says("verdict", whole & ~_one_of(x, "verdict", GATE_VERDICTS)), _says("checks", whole & (_kind(_at(x, "checks")) != "ARRAY"))]


def _milestone(x: Column) -> list[Column]:
    whole = F.size(F.array_except(F.array(*map(F.lit, ("id", "name", "deps", *REVIEWED))), _keys(x))) == 0
    return [_says("fields", ~whole), _says("deps", whole & (_kind(_at(x, "deps")) != "ARRAY")), *[_says(f, whole & ~_one_of(x, f, STATUSES)) for f in REVIEWED]]


def state_problems(states: DataFrame, doc_col: str = "state", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """keys, problem: a row for each rule that a JSON state document breaks, named by the place; valid documents have none.

    Text that is null, no JSON or no object has the one problem `document`. Rules on a part are
    skipped where the part itself is of the wrong kind, which is a problem of its own.
    """
    doc = F.col("_doc")
    nested = lambda f: (_kind(_at(doc, f.split(".")[0])) == "OBJECT") if "." in f else F.lit(True)
    top = [F.array_compact(F.array(*[_says(f"{f}: kind", nested(f) & (_kind(_at(doc, f)) != kind)) for f, kind in KIND_OF.items()]))]
    values = [_says("report_id", F.coalesce(_text_at(doc, "report_id"), F.lit("")) == "")]
    values += [_says(f, ~_one_of(doc, f, allowed)) for f, allowed in MUST_BE.items()]
    values += [_says(f, ~(_kind(_at(doc, f)).isin("", "VOID") | _one_of(doc, f, allowed))) for f, allowed in MAY_BE.items()]
    values += [_says(f"{f}: missing", (_kind(_at(doc, f.split(".")[0])) == "OBJECT") & (_kind(_at(doc, f)) == "")) for f in ("iteration.max", "verdict.result")]
    is_stages = _kind(_at(doc, "stages")) == "OBJECT"
    for stage in STAGES:
        here = is_stages & (_kind(_at(doc, f"stages.{stage}")) == "OBJECT")
        tries = F.try_variant_get(doc, f"$.stages.{stage}.attempts", "long")
        values += [
            _says(f"stages.{stage}: kind", is_stages & ~here),
            _says(f"stages.{stage}.status", here & ~_one_of(doc, f"stages.{stage}.status", STATUSES)),
            _says(f"stages.{stage}.attempts", here & ~((_kind(_at(doc, f"stages.{stage}.attempts")) == "BIGINT") & F.coalesce(tries >= 0, F.lit(False)))),
        ]
    named = lambda head, names: F.transform(names, lambda n: F.concat(F.lit(head), n))
    fields, stages = F.array(*map(F.lit, FIELDS)), F.array(*map(F.lit, STAGES))
    parts = [
        named("missing: ", F.array_except(fields, _keys(doc))),
        named("unknown: ", F.array_except(_keys(doc), fields)),
        named("unknown stage: ", F.array_except(_keys(_at(doc, "stages")), stages)),
        *top, F.array_compact(F.array(*values)), _items(doc, "gates", _gate), _items(doc, "milestones", _milestone),
    ]
    ids = F.filter(F.transform(F.try_variant_get(doc, "$.milestones", "array<variant>"), lambda m: F.try_variant_get(m, "$.id", "string")), lambda i: i.isNotNull())
    twice = F.when(F.size(ids) > F.size(F.array_distinct(ids)), F.array(F.lit("milestones: repeated id")))
    parts.append(F.coalesce(twice, F.array().cast("array<string>")))
    found = F.when(F.coalesce(_kind(doc), F.lit("")) == "OBJECT", F.concat(*parts)).otherwise(F.array(F.lit("document")))
    return states.withColumn("_doc", F.try_parse_json(doc_col)).select(*keys, F.explode(found).alias("problem"))
