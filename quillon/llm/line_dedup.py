"""Line dedup by site-relative frequency.

For every host, the share of its pages that hold a line is that line's ratio;
lines above the boilerplate ratio that at least LEAST pages hold are dropped from
all pages of the host, however few it has. Lines are counted by two 64-bit hashes,
once a page, with partial sums before the shuffle. A host has at most (mean distinct
lines of a page) / ratio such lines; a page first intersects its hashes with them by
hashing, so only lines that it shares with its host's list are compared. Lists are a written table whose size the planner
knows, so it joins them by broadcast where they are small and by a skew-aware
shuffle where they aren't.

Defined cases: a null text has no lines and stays null; blank lines are kept and
never counted; a line on fewer than LEAST pages stays, so hosts with fewer pages
drop nothing; pages without host are a host of their own; repeated rows are pages of their own; a page that
loses all lines keeps an empty text. All columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, written

RATIO = 0.1
LEAST = 3  # pages of a host that hold a line: fewer don't show that it repeats


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """_line_host, _line_keys: the lines to drop, a row for each host that has some."""
    pages = df.select(F.col(host_col).alias("_line_host"), F.col(text_col).cast("string").alias("_line_text"))
    totals = written(pages.groupBy("_line_host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least), "line_hosts")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_line_text")), _filled), _key))
    counts = pages.select("_line_host", F.explode(keys).alias("k")).groupBy("_line_host", "k.a", "k.b").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= least).join(totals.withColumnRenamed("_line_host", "host"), F.col("_line_host").eqNullSafe(F.col("host"))).where(F.col("n") > ratio * F.col("pages"))
    return written(often.groupBy("_line_host").agg(F.collect_list(F.struct("a", "b")).alias("_line_keys")), "line_boilerplate")


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """df with text_col cleaned, and line_count and line_dropped, which replace columns of those names."""
    lists = boilerplate(df, host_col, text_col, ratio, least)
    joined = df.join(lists, F.col(host_col).eqNullSafe(F.col("_line_host")), "left")
    lines = _lines(F.col(text_col).cast("string"))
    own = F.transform(lines, lambda x: F.xxhash64(x))
    joined = joined.withColumn("_line_shared", F.when(F.col("_line_keys").isNotNull(), F.array_intersect(own, F.transform("_line_keys", lambda k: k["a"]))))
    dropped = lambda x: F.array_contains("_line_shared", F.xxhash64(x)) & _filled(x) & F.array_contains("_line_keys", _key(x))
    joined = joined.withColumn("_line_kept", F.when(F.size("_line_shared") > 0, F.filter(lines, lambda x: ~dropped(x))).otherwise(lines))
    joined = joined.withColumn("line_count", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    joined = joined.withColumn("line_dropped", F.when(F.col("_line_kept").isNull(), 0).otherwise(F.col("line_count") - F.size("_line_kept")).cast("long"))
    return joined.withColumn(text_col, F.array_join("_line_kept", "\n")).drop("_line_host", "_line_keys", "_line_shared", "_line_kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), "text")


SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT l.source, l.line FROM l JOIN h ON h.source = l.source WHERE length(trim(l.line)) > 0
      GROUP BY l.source, l.line, h.pages HAVING count(DISTINCT l.doc_id) > {RATIO} * h.pages AND count(DISTINCT l.doc_id) >= {LEAST})
SELECT l.doc_id, l.source, count(*) AS n_lines, count(b.line) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL), '') AS text
FROM l LEFT JOIN b ON b.source = l.source AND b.line = l.line
GROUP BY l.doc_id, l.source
"""
QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE_SQL = {"op7_line_dedup": SQL}
