"""Licence scans: ordered signature rules over whole texts, inside the JVM.

A text is normalised once to lower-case words with one space around each. One
cheap pass asks whether any keyword occurs; only then is each rule whose own
keyword occurs tried. A hit is an interval of words. A hit that lies inside the
interval of another of the same or a better priority is suppressed; hits of the
base phrases always count.

Defined cases: a null text is an empty one and has no words; a text without a
hit has null first_word and last_word, empty labels and score 0; equal rows give
equal rows; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import Rule, gates, rules
from .shared import documents, let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\u0001"
RUN = 256


def normalised(text: Column) -> Column:
    """Words with one space before, between and after them.

    lower() equals lower-casing A-Z here: beyond ASCII, only U+0130 and U+212A
    become ASCII letters; the first keeps a combining dot, and no base phrase has a k.
    """
    body = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, " "))
    return F.concat(F.lit(" "), body, F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_table(table: list[Rule]) -> Column:
    """An array of keywords, each with the array of its rules, as one constant."""
    by_keyword: dict[str, list[dict]] = {}
    for i, r in enumerate(table):
        rule = {"rank": i, "regex": f" (?:{r.regex})(?= )", "label": r.label, "priority": r.priority, "weight": r.weight, "base": r.base}
        by_keyword.setdefault(" " + r.keyword, []).append(rule)
    rules_ = json.dumps([{"keyword": k, "rules": own} for k, own in by_keyword.items()])
    return F.from_json(F.lit(rules_), "array<struct<keyword:string,rules:array<struct<rank:int,regex:string,label:string,priority:int,weight:double,base:boolean>>>>")


def _hits(norm: Column, rule: Column) -> Column:
    """All places of one rule: the marks give the starts, the matches the lengths.

    A match begins with the space before its first word, so a mark ends the word before.
    """

    def placed(matches: Column) -> Column:
        words = F.split(F.regexp_replace(norm, rule["regex"], F.lit(MARK + "$0")), " ", -1)
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.endswith(MARK), i)), lambda x: x.isNotNull())
        return F.zip_with(
            starts,
            F.transform(matches, lambda m: spaces(m) - 1),
            lambda s, n: F.struct(
                s.alias("start"), (-(s + n)).alias("minus_end"), rule["priority"].alias("priority"), rule["rank"].alias("rank"),
                rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
            ),
        )

    return let(F.regexp_extract_all(norm, rule["regex"], F.lit(0)), placed)


def _unsuppressed(hits: Column, levels: int) -> Column:
    """hits sorted by start, longest first, best priority first: what could contain a hit comes before it.

    Hits are gone through RUN at a time: appending to an array copies it, so one long array of
    kept hits would cost the square of their number.
    """
    none = F.array_repeat(F.lit(-1), levels)

    def step(acc: Column, hit: Column) -> Column:
        end = -hit["minus_end"]
        inside = F.exists(F.slice(acc["ends"], F.lit(1), hit["priority"]), lambda e: e >= end)
        return F.struct(
            F.transform(acc["ends"], lambda e, i: F.when((i + 1 == hit["priority"]) & ~hit["base"], F.greatest(e, end)).otherwise(e)).alias("ends"),
            F.when(inside | hit["base"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(hit))).alias("kept"),
        )

    no_hits = F.slice(hits, F.lit(1), F.lit(0))

    def run(acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(hits, i * RUN + 1, F.lit(RUN)), F.struct(acc["ends"].alias("ends"), no_hits.alias("kept")), step)
        return let(own, lambda o: F.struct(o["ends"].alias("ends"), F.concat(acc["runs"], F.array(o["kept"])).alias("runs")))

    runs = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int"))
    start = F.struct(none.alias("ends"), F.slice(F.array(no_hits), F.lit(1), F.lit(0)).alias("runs"))
    return F.aggregate(runs, start, run, lambda acc: F.flatten(acc["runs"]))


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per input row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    table = table or rules()
    any_keyword = F.lit(False)
    for stem in gates({r.keyword for r in table}):
        any_keyword = any_keyword | F.contains(F.col("norm"), F.lit(stem))
    norm = F.col("norm")

    def tried(keywords: Column) -> Column:
        hit = F.filter(keywords, lambda k: F.contains(norm, k["keyword"]))
        return F.sort_array(F.flatten(F.transform(F.flatten(F.transform(hit, lambda k: k["rules"])), lambda r: _hits(norm, r))))

    found = let(_rule_table(table), tried)
    base = F.filter("hits", lambda h: h["base"])
    kept = _unsuppressed(F.col("hits"), max(r.priority for r in table))
    out = (
        df.select(F.col(id_col), normalised(F.col(text_col)).alias("norm"))
        .select(F.col(id_col), F.when(F.length("norm") > 2, spaces(norm) - 1).otherwise(0).cast("long").alias("n_words"), F.when(any_keyword, found).alias("hits"))
        .select(id_col, "n_words", F.when(F.size("hits") > 0, base).alias("base"), F.when(F.size("hits") > 0, kept).alias("kept"))
    )
    names = F.transform("base", lambda h: h["label"])
    starts = F.transform("base", lambda h: h["start"])
    return out.select(
        id_col,
        "n_words",
        F.greatest(F.size(F.coalesce("base", F.array())), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(_joined(names), F.lit("")).alias("base_labels"),
        F.coalesce(_joined(F.concat(names, F.transform("kept", lambda h: h["label"]))), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "kept"), lambda h: h["weight"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("first"), (-h["minus_end"]).alias("last"))).alias("detections"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("detections")


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL: dict[str, str] = {}
