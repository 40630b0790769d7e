"""Quality rules with host verdicts.

Each document is measured once and tested by document rules. Failures are summed
by host; a beta prior fitted to all hosts' rates (method of moments) shrinks each
rate, so hosts with few documents stay near the common one. The prior weighs as
much as MOST_PRIOR documents at most. A host whose shrunk rate lies more than
DEVIATIONS standard deviations of the prior above its mean is suspect, and loses
the documents that fail any softer rule as well; its clean documents stay. Only
counts by host are shuffled.

Defined cases: a null text has no words and fails; documents without host are a
host of their own; repeated rows count as often as they are there; an empty table
gives an empty result. check() leaves other columns out, filtered() keeps them.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, small_batches, written

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # percent of words in repeated windows

#: Limits of the softer rules and of hosts.
MOST_SYMBOLS = 0.1  # symbols a word
MOST_DUP_LINES = 0.3
LEAST_MEAN, MOST_MEAN = 2.0, 15.0  # characters a word
DEVIATIONS = 1.0  # of the fitted prior, above which a host is suspect
MOST_PRIOR = 50.0  # documents that the prior weighs as much as, at most


def repeated_words(words: list) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    codes = ids
    for width in range(1, WINDOW):  # codes of windows: equal exactly if the windows are
        pairs = codes[:-1] * len(words) + ids[width:]
        codes = np.unique(pairs, return_inverse=True)[1]
    starts = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-WINDOW] += starts
    edge[WINDOW:] -= starts
    return int((np.cumsum(edge[:-1]) > 0).sum())


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_dup_lines", "n_repeat_words")]))
def counted(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        raw = (t or "").encode()
        words = raw.split()  # bytes: ASCII white space only
        lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
        rows.append((len(words), len(lines) - len(set(lines)), repeated_words(words)))
    return pd.DataFrame(rows, columns=["n_words", "n_dup_lines", "n_repeat_words"], dtype="int64")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with a struct column: the counts, base_failed and soft_failed."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("_quality_counted", counted(text))  # used many times, so it stays a column of its own
    c = F.col("_quality_counted")
    n = c["n_words"]
    word_chars = _without(text, BLANKS).cast("long")
    n_symbols = (F.length(text) - _without(text, SYMBOLS)).cast("long")
    base = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * n)
    soft = (n_symbols > MOST_SYMBOLS * n) | (c["n_dup_lines"] > MOST_DUP_LINES * (F.length(text) - _without(text, "\n") + 1)) | (word_chars < LEAST_MEAN * n) | (word_chars > MOST_MEAN * n)
    made = F.struct(n.alias("n_words"), word_chars.alias("word_chars"), n_symbols.alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), soft.alias("soft_failed"))
    return df.withColumn(out, made).drop("_quality_counted")


def host_verdicts(rows: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """rows: host, failed. The suspect hosts: _suspect, _suspect_rate (shrunk)."""
    hosts = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f")), "quality_hosts")
    share = F.col("f") / F.col("n")
    count, mean, spread, inverse = hosts.agg(F.count(F.lit(1)), F.sum("f") / F.sum("n"), F.var_samp(share), F.avg(1 / F.col("n"))).first() if hosts.take(1) else (0, None, None, None)
    strength, mean = prior_strength(count, mean, spread, inverse), mean or 0.0
    rate = (F.col("f") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    limit = mean + deviations * (mean * (1 - mean) / (strength + 1)) ** 0.5
    return hosts.select(F.col("host").alias("_suspect"), rate.alias("_suspect_rate")).where(F.col("_suspect_rate") > limit)


def prior_strength(count: int, mean: float | None, spread: float | None, inverse: float | None) -> float:
    """alpha + beta of the prior: the hosts' spread less what chance alone gives; 10 where it can't be told, MOST_PRIOR where it is all chance."""
    if count < 3 or not mean or mean >= 1 or spread is None:
        return 10.0
    real = spread - mean * (1 - mean) * inverse
    return float(min(MOST_PRIOR, max(1.0, (mean * (1 - mean) - real) / real))) if real > 0 else MOST_PRIOR


def _with_verdicts(rows: DataFrame, host: Column, base: Column, soft: Column, kept: str) -> DataFrame:
    """rows and whether each is kept; the table of suspects is small and its size known, so the planner may broadcast it."""
    suspects = host_verdicts(rows.select(host.alias("host"), (base | soft).alias("failed")))
    joined = rows.join(suspects, host.eqNullSafe(F.col("_suspect")), "left")
    return joined.withColumn(kept, ~base & ~(F.col("_suspect_rate").isNotNull() & soft))


def check(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id_col, the measures, base_failed and kept of every row; measures are written once and read twice."""
    rows = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    rows = written(measured(rows, "text", "m").select("id", "host", "m.*"), "quality")
    out = _with_verdicts(rows, F.col("host"), F.col("base_failed"), F.col("soft_failed"), "kept")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filtered(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept rows of df; rows are measured once and written with their measures."""
    names = df.columns
    rows = written(measured(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), f"row.`{text_col}`", "m"), "quality_rows")
    return _with_verdicts(rows, F.col(f"row.`{host_col}`"), F.col("m.base_failed"), F.col("m.soft_failed"), "kept").where("kept").select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(documents(spark, sf_dir))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL = {
    "op6_quality": f"""
WITH w AS (SELECT doc_id, source, text, [x FOR x IN regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS ws, string_split(text, chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest(range(0, {WINDOW})) AS j) WHERE n > 1 GROUP BY 1),
m AS (SELECT w.doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len([l FOR l IN ls IF regexp_matches(l, '[^ \\t\\x0B\\f\\r]')]) - len(list_distinct([l FOR l IN ls IF regexp_matches(l, '[^ \\t\\x0B\\f\\r]')])) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines
 FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
 n_symbols > {MOST_SYMBOLS} * n_words OR n_dup_lines > {MOST_DUP_LINES} * n_lines OR word_chars < {LEAST_MEAN} * n_words OR word_chars > {MOST_MEAN} * n_words AS soft_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END)::DOUBLE AS f FROM v GROUP BY 1),
q AS (SELECT count(*) AS hosts, sum(f) / sum(n) AS mean, var_samp(f / n) AS spread, avg(1 / n) AS inverse FROM h),
p AS (SELECT *, spread - mean * (1 - mean) * inverse AS real FROM q),
k AS (SELECT mean, CASE WHEN hosts < 3 OR mean = 0 OR mean >= 1 THEN 10 WHEN real > 0 THEN least({MOST_PRIOR}, greatest(1, (mean * (1 - mean) - real) / real)) ELSE {MOST_PRIOR} END AS strength FROM p),
s AS (SELECT source FROM h, k WHERE (f + strength * mean) / (n + strength) > mean + {DEVIATIONS} * sqrt(mean * (1 - mean) / (strength + 1)))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (soft_failed AND source IN (SELECT source FROM s)) AS kept FROM v
"""
}
