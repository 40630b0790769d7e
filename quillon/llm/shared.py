"""What the training-data operators share; their written tables lie where every executor can reach them.

Lineage is cut only through these: executors may be lost at any time, so nothing
that a later stage reads may live on one machine alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder as new_folder  # noqa: F401
from ..sources.scratch import table as written  # noqa: F401


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on the session sends at most so many bytes to a Python worker at once, or what it was set to if that is less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, f"{most}b").removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def let(value: Column, body) -> Column:
    """Evaluate value once and use it several times inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
