"""Mixing sources to target weights by Poisson replication, inside the JVM.

Each source has a rate: how often a document of it is to be repeated on average
so that the mixture gets the target weights. A document's number of copies is a
Poisson variable of that mean, found by inverting the distribution at a uniform
number made from a hash of seed and doc_id: the same whatever the partitions.
The copies are dealt to partitions by a hash and sorted by it within each: a
global shuffle that can be repeated.

Rates over STEP are drawn as a sum of several smaller ones, whose sum has the
same distribution; no rate is capped.

A row whose doc_id is null or repeated is drawn on its own: its seed has a hash of
the whole row besides, and its number among equal rows. Equal rows are counted
and dealt out again in blocks of BLOCK, so none of them needs to meet in one task.

Defined cases: documents without source are a source of their own; an empty table gives an empty result. All columns of the input are kept; should
the input have a copy or shuffle_key column, the new one takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, written

STEP = 64.0  # largest mean of a single draw
SEED = "quillon-mix"
ALPHA = 0.7  # target weights: the power of a source's share
UNIT = float(1 << 52)
BLOCK = 1000  # equal rows that one task numbers at once


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(UNIT)


def cumulative(mean: Column) -> Column:
    """Poisson probabilities summed up, as far as a double can tell them from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["sums"])


def rates(df: DataFrame, source_col: str, weights: dict[str, float] | None, total: float | None, alpha: float) -> DataFrame:
    """_mix_source, _mix_rate, _mix_draws and _mix_sums (of one draw): a row for each source."""
    sizes = df.groupBy(F.col(source_col).alias("_mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.try_element_at(given, F.col("_mix_source")), F.lit(0.0)) if weights else F.lit(0.0)
    sizes = written(sizes.withColumn("weight", weight), "mix_sizes")
    rows, whole = sizes.agg(F.sum("n"), F.sum("weight")).first()
    factor = (total if total is not None else float(rows or 0)) / (whole or 1.0)
    rate = F.lit(factor) * F.col("weight") / F.col("n")
    draws = F.greatest(F.ceil(rate / STEP), F.lit(1)).cast("int")
    out = sizes.select("_mix_source", rate.alias("_mix_rate"), draws.alias("_mix_draws"))
    return written(out.withColumn("_mix_sums", cumulative(F.col("_mix_rate") / F.col("_mix_draws"))), "mix_rates")


def named(df: DataFrame, id_col: str) -> DataFrame:
    """df with _mix_name, which no two rows share: doc_id where it is given once, else with the row's hash and number."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    ids = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_mix_again")).agg(F.count(F.lit(1)).alias("_mix_n"))
    again = written(ids.where("_mix_n > 1").select("_mix_again"), "mix_repeated")
    repeated = bool(again.take(1))
    if not repeated and not df.where(F.col(id_col).isNull()).take(1):
        return df.withColumn("_mix_name", name)
    once, rest = df.where(F.col(id_col).isNotNull()), df.where(F.col(id_col).isNull())
    if repeated:
        same = F.col(id_col) == F.col("_mix_again")
        rest = rest.unionByName(df.join(again, same, "left_semi"))
        once = once.join(again, same, "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = rest.select(F.md5(F.to_json(F.struct(*columns))).alias("_mix_hash"), *columns)
    equal = hashed.groupBy("_mix_hash").agg(*[F.first(c).alias(name_) for c, name_ in zip(columns, df.columns)], F.count(F.lit(1)).alias("_mix_n"))
    blocks = equal.withColumn("_mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_n") - 1) / BLOCK)))).repartition("_mix_hash", "_mix_block")
    first = F.col("_mix_block") * BLOCK
    rows = blocks.withColumn("_mix_number", F.explode(F.sequence(first + 1, F.least(first + BLOCK, F.col("_mix_n")))))
    parts = rows.select(*columns, "_mix_hash", "_mix_number")
    parts = parts.withColumn("_mix_name", F.concat_ws(":", name, "_mix_hash", F.col("_mix_number").cast("string"))).drop("_mix_hash", "_mix_number")
    return once.withColumn("_mix_name", name).unionByName(parts)


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, total: float | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """The rows of df, each as often as drawn, with copy (from 1) and shuffle_key, shuffled.

    weights: target weight by source, those not named get none; by default the power
    alpha of the source's number of documents. total: expected rows, by default as many as df has.
    The rates are a small table whose size the planner knows, so it decides on a broadcast.
    """
    table = rates(df, source_col, weights, total, alpha)
    name = F.col("_mix_name")
    joined = named(df.drop("copy", "shuffle_key"), id_col).join(table, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_draws")),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter("_mix_sums", lambda c: c <= uniform(F.lit(seed), name, j.cast("string")))),
    )
    copies = joined.withColumn("_mix_count", drawn).where("_mix_count > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_count"))))
    key = F.md5(F.concat_ws(":", F.lit(seed + "-order"), name, F.col("copy").cast("string")))
    out = copies.withColumn("shuffle_key", key).drop("_mix_source", "_mix_rate", "_mix_draws", "_mix_sums", "_mix_count", "_mix_name")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "shuffle_key", "text")


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL = {
    "op8_mixing": f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
w AS (SELECT sum(n) AS total, sum(pow(n, {ALPHA})) AS whole FROM s),
r AS (SELECT source, total / whole * pow(n, {ALPHA}) / n AS rate FROM s, w),
k AS (SELECT source, i.k AS k, exp(-rate) * pow(rate, i.k) / gamma(i.k + 1) AS p FROM r, (SELECT unnest(range(0, 60))::DOUBLE AS k) AS i),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM k),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::BIGINT / {UNIT} AS u FROM documents),
m AS (SELECT u.doc_id, u.source, u.text, count(*) AS copies FROM u JOIN c ON c.source = u.source AND c.upto <= u.u GROUP BY ALL)
SELECT doc_id, source, i AS copy, md5('{SEED}-order:' || doc_id || ':' || i) AS shuffle_key, text
FROM (SELECT *, unnest(range(1, copies + 1)) AS i FROM m)
"""
}
