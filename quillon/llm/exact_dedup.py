"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are identical after lower-casing A-Z. Every row's length
and the hash of its first PREFIX characters are written as a narrow table. Lengths
that occur once drop out, then beginnings that occur once; only rows whose length
and beginning occur again have their whole text read and hashed.

Which rows those are is told to the scan by a bitmap: one bit for a hash of each
(length, beginning) that occurs again. It has at most MOST_BITS bits, 8 MB, whatever
the corpus; a bit that is set by chance costs the hash of one text and changes no
result, as rows are grouped by exact length and SHA-256 afterwards. So no text is
shuffled, and a group of copies meets only as partial maxima and counts.

Defined cases: a null text is an empty one, and empty texts are copies of each
other; of a group the row with the largest doc_id stays, a row without doc_id only
where all have none; of repeated rows with that doc_id one stays; rows keep their
number; an empty table gives an empty result; other columns are left out by
exact_duplicates and kept by deduplicated, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, small_batches, written

PREFIX = 64  # characters that the second step compares
BUCKET_BITS = 1 << 15  # of a bitmap row
BITS_A_KEY = 16
MOST_BITS = 1 << 26
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


@F.pandas_udf(T.StringType())
def text_digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of the text with A-Z lower-cased, in hex; null for null."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else hashlib.sha256(t.encode().lower()).hexdigest())  # bytes: A-Z only


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """keys: length, prefix. Rows (bucket, bits), and the number of places."""
    places = BUCKET_BITS
    wanted = min(MOST_BITS, keys.count() * BITS_A_KEY)
    while places < wanted:
        places *= 2
    at = keys.select(F.pmod(F.xxhash64("length", "prefix"), F.lit(places)).alias("at"))
    at = at.select(F.shiftright("at", 15).alias("_copy_bucket"), F.col("at").bitwiseAND(BUCKET_BITS - 1).alias("bit"))
    return at.groupBy("_copy_bucket").agg(F.bitmap_construct_agg("bit").alias("_copy_bits")), places


def refined(signatures: DataFrame) -> DataFrame:
    """signatures: length, prefix of every row. The pairs that occur again."""
    lengths = signatures.groupBy("length").count().where("count > 1").select("length")
    again = signatures.groupBy("length", "prefix").count().join(lengths, "length", "left_semi")  # sums by pair meet the lengths, not rows
    return written(again.where("count > 1").select("length", "prefix"), "copy_prefixes")


def _marked(df: DataFrame, text: Column) -> DataFrame:
    """df with _copy_length and _copy_hash; the latter is null where no other row has the same length and beginning."""
    small_batches(df.sparkSession)
    text = F.coalesce(text.cast("string"), F.lit(""))
    length, prefix = F.octet_length(text), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX)))  # lower-casing A-Z keeps lengths
    keys = refined(written(df.select(length.alias("length"), prefix.alias("prefix")), "copy_signatures"))
    bits, places = bitmap(keys)
    place = F.pmod(F.xxhash64(length, prefix), F.lit(places))
    rows = df.withColumns({"_copy_length": length, "_copy_place": place})
    rows = rows.join(F.broadcast(bits), F.shiftright("_copy_place", 15) == F.col("_copy_bucket"), "left")  # MOST_BITS / 8 bytes at most
    bit = F.col("_copy_place").bitwiseAND(BUCKET_BITS - 1).cast("int")
    byte = F.conv(F.hex(F.substring("_copy_bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1, F.lit(False))
    return rows.withColumn("_copy_hash", text_digest(F.when(held, text))).drop("_copy_place", "_copy_bucket", "_copy_bits")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """id_col, keep_id, group_size and kept of every row, and the columns of carry, which are computed where the text is."""
    carry = carry or {}
    base = df.select(F.col(f"`{id_col}`").alias("_copy_id"), F.col(f"`{text_col}`").alias("_copy_text"), *[c.alias(f"_carry_{name}") for name, c in carry.items()])
    rows = _marked(base, F.col("_copy_text")).drop("_copy_text").withColumn("_copy_row", F.monotonically_increasing_id())
    rows = written(rows, "copy_rows")
    best = F.max(F.struct("_copy_id", "_copy_row")).alias("best")
    groups = rows.where("_copy_hash IS NOT NULL").groupBy("_copy_length", "_copy_hash").agg(best, F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = written(groups.select(F.col("_copy_length").alias("length"), F.col("_copy_hash").alias("hash"), "best", "size"), "copy_groups")
    held = rows.where("_copy_hash IS NOT NULL").join(groups, (F.col("_copy_length") == F.col("length")) & (F.col("_copy_hash") == F.col("hash")), "left")
    out = lambda keep, size, kept: [F.col("_copy_id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), *[F.col(f"_carry_{name}").alias(name) for name in carry]]
    alone = F.col("size").isNull()
    single = rows.where("_copy_hash IS NULL").select(*out(F.col("_copy_id"), F.lit(1), F.lit(True)))
    return single.unionByName(
        held.select(*out(F.when(alone, F.col("_copy_id")).otherwise(F.col("best._copy_id")), F.coalesce("size", F.lit(1)), alone | (F.col("best._copy_row") == F.col("_copy_row"))))
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each text: the one with the largest id_col, of equal ones the one whose other columns have the largest hash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = _marked(df.select(row.alias("row")), F.col(f"row.`{text_col}`"))
    single = rows.where("_copy_hash IS NULL").select("row.*")
    order = F.struct(F.col(f"row.`{id_col}`"), F.xxhash64(F.to_json("row")))
    again = rows.where("_copy_hash IS NOT NULL").groupBy("_copy_length", "_copy_hash").agg(F.max_by("row", order).alias("row"))
    return single.unionByName(again.select("row.*"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact_duplicates(docs, carry={"text_sha256": text_digest(F.coalesce(F.col("text").cast("string"), F.lit("")))})


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLE_SQL = {
    "op12_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(x) AS text_sha256
FROM t WINDOW same AS (PARTITION BY x)
"""
}
