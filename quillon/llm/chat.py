"""Chat formatting: every assistant turn becomes an example of its own, inside the JVM.

An example holds all turns before its target as context and the target as its
only trainable text. Turns that follow the last assistant turn come in a last
example without a target, so the whole conversation can be read back.

    <|turn|>role<|says|>text<|end|>\\n

Role and text are escaped: a backslash is doubled, and a backslash is put after
the first character of any control string of this or of common templates. So no
control string stands in an escaped text, and unescaping gives the text back.

Defined cases: a null text or role is empty; turns are ordered by (turn, role,
text), nulls first; repeated rows are turns of their own; a row without conv_id
belongs to no other, so it is a conversation of one turn; no rows give no examples;
other columns are left out. The output of a conversation grows with the square of
its turns, as the method says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of the template.
OPEN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(?!\\)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """conv_col, loose (a number for each row without conv_col), example, formatted, loss_start (code points from 1), loss_length, trainable."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col), F.struct(F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text")).alias("turn"))
    rows = rows.withColumn("loose", F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()))
    turns = rows.groupBy(conv_col, "loose").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    said = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SAYS)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target).alias("trainable")),
    )
    turns = turns.select(conv_col, "loose", said.alias("said"))
    positions = F.sequence(F.lit(1), F.size("said"))
    ends = F.array_distinct(F.concat(F.filter(positions, lambda i: F.element_at("said", i)["trainable"]), F.array(F.size("said"))))
    whole = F.transform("said", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    rows = turns.withColumn("whole", whole).select(conv_col, "loose", "said", "whole", F.explode(ends).alias("example"))
    last = F.element_at("said", F.col("example"))
    rows = rows.select(conv_col, "loose", "example", F.array_join(F.slice("whole", F.lit(1), F.col("example") - 1), "").alias("context"), last.alias("last"))
    return rows.select(
        conv_col,
        "loose",
        "example",
        F.concat("context", "last.head", "last.body", F.lit(END)).alias("formatted"),
        (F.length("context") + F.length("last.head") + 1).alias("loss_start"),
        F.when(F.col("last.trainable"), F.length("last.body")).otherwise(0).alias("loss_length"),
        F.col("last.trainable").alias("trainable"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text)."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p: F.length(p) > 0)
    return F.transform(
        F.transform(parts, lambda p: F.split(p, r"<\|says\|>", 2)),
        lambda p: F.struct(
            unescape(F.element_at(p, 1)).alias("role"),
            unescape(F.substring(F.element_at(p, 2), F.lit(1), F.length(F.element_at(p, 2)) - len(END))).alias("text"),
        ),
    )


def digest(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the examples of each conversation say when they are read back."""
    loss = unescape(F.substring("formatted", F.col("loss_start"), F.col("loss_length")))
    back = made.groupBy(conv_col, "loose").agg(
        F.max_by("formatted", "example").alias("full"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", loss.alias("said"))))), lambda x: x["said"]), "").alias("loss"),
    )
    back = back.withColumn("turns", parsed(F.col("full")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return digest(examples(table.unionByName(own)))


QUERIES = {"op10_chat": op10_chat}
_ESCAPED = r"regexp_replace(replace({x}, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"
ORACLE_SQL = {
    "op10_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, {len(OPEN + SAYS + END)} + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}) AS size, row_number() OVER (PARTITION BY conv_id, loose ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id, loose) AS n
 FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS loose FROM t)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, loose ORDER BY i) AS upto FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, loose
"""
}
