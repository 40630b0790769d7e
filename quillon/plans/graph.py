"""Dependency graphs of milestones, for any number of cases at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import table

#: A milestone with more dependencies than this is never looked through.
SHORT = 4


def never_free(milestones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, id: the milestones that no order can start, as they are on a cycle or wait for one.

    milestones: by, id, deps. Dependencies on ids that the case doesn't have don't count, nor do rows
    without an id; rows of one id are one milestone with all their dependencies; a null case is a case.

    In a round, dependencies on milestones that wait for nothing go, and the others are looked through: a
    milestone waits for what its dependencies wait for, so a chain's links double their length and rounds follow
    the logarithm of its depth. No milestone's list outgrows its own or SHORT, whichever is more; where it would, it stays. A
    round that frees no milestone ends it: without a cycle behind them the first ones in any order would have gone.
    """
    case = F.struct(*[F.col(c) for c in by], F.lit(1).alias("_one")).alias("case")
    edges = milestones.select(case, "id", F.explode("deps").alias("dep")).where("id IS NOT NULL AND dep IS NOT NULL").distinct()
    known = milestones.where("id IS NOT NULL").select(case, F.col("id").alias("dep")).distinct()
    edges = edges.join(known, ["case", "dep"], "left_semi")
    nodes, left = _counted(edges.groupBy("case", "id").agg(F.collect_list("dep").alias("deps")))
    while left:
        links = nodes.select("case", "id", F.size("deps").alias("n"), F.explode("deps").alias("dep"))
        beyond = nodes.select("case", F.col("id").alias("dep"), F.when(F.size("deps") <= SHORT, F.col("deps")).otherwise(F.array("id")).alias("beyond"))
        seen = links.join(beyond, ["case", "dep"]).groupBy("case", "id").agg(F.max("n").alias("n"), F.collect_list("dep").alias("near"), F.array_distinct(F.flatten(F.collect_list("beyond"))).alias("far"))
        deps = F.when(F.size("far") <= F.greatest(F.col("n"), F.lit(SHORT)), F.col("far")).otherwise(F.col("near"))
        before = left
        nodes, left = _counted(seen.select("case", "id", deps.alias("deps")))
        if left == before:
            break
    return nodes.select(*[F.col("case")[c].alias(c) for c in by], "id")


def _counted(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The rows in a table and their number, which the job that writes them counts too."""
    seen = Observation()
    made = table(nodes.observe(seen, F.count(F.lit(1)).alias("n")), "milestones")
    return made, seen.get["n"]
