"""Co-moments of all pairs of members over the observations that both have.

Members (assets, models) are dealt into tiles of some TILE. A row of the panel goes
to the pairs of tiles that hold its own, and observations are dealt into parts, so a
task multiplies matrices of two tiles: counts, sums and cross products of complete
pairs are products of the values and of their presence. Spark adds the parts up. The
panel is never joined with itself: a row is copied once for each tile, not for each member.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
ROWS = 500_000  # of the panel that a task takes, about
AT_ONCE = 2048  # observations of a matrix
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
ENDS = ["x_low", "x_high", "y_low", "y_high"]


def _products(keys: Sequence[str], kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = int(pdf["_left"].iloc[0]), int(pdf["_right"].iloc[0])
        seen = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(seen, kind="stable")
        seen, member, tile, value = seen[order], pdf["_member"].to_numpy()[order], pdf["_tile"].to_numpy()[order], pdf["_x"].to_numpy(float)[order]
        rows, cols = (np.unique(member[tile == t]) for t in (left, right))
        sums = {s: np.zeros((len(rows), len(cols))) for s in SUMS}
        ends = {e: np.full((len(rows), len(cols)), np.inf if e.endswith("low") else -np.inf) for e in ENDS}

        def matrix(own: np.ndarray, names: np.ndarray, first: int, n: int) -> np.ndarray:
            out = np.full((n, len(names)), np.nan)
            out[seen[own] - first, np.searchsorted(names, member[own])] = value[own]
            return out

        for first in range(0, int(seen[-1]) + 1, AT_ONCE):
            here = slice(*np.searchsorted(seen, [first, first + AT_ONCE]))
            index, n = np.arange(here.start, here.stop), min(AT_ONCE, int(seen[-1]) + 1 - first)
            x = matrix(index[tile[here] == left], rows, first, n)
            y = x if left == right else matrix(index[tile[here] == right], cols, first, n)
            mx, my = ~np.isnan(x), ~np.isnan(y)
            x0, y0, fx, fy = np.where(mx, x, 0.0), np.where(my, y, 0.0), mx.astype(float), my.astype(float)
            for name, a, b in (("n", fx, fy), ("sx", x0, fy), ("sy", fx, y0), ("sxx", x0 * x0, fy), ("syy", fx, y0 * y0), ("sxy", x0, y0)):
                sums[name] += a.T @ b
            for i in range(len(rows)):
                both = my & mx[:, [i]]
                own = np.where(both, x[:, [i]], np.nan)
                other = np.where(both, y, np.nan)
                for name, f, v in (("x_low", np.fmin, own), ("x_high", np.fmax, own), ("y_low", np.fmin, other), ("y_high", np.fmax, other)):
                    ends[name][i] = f(ends[name][i], f.reduce(v, axis=0))
        i, j = np.nonzero(sums["n"])
        if left == right:
            i, j = i[rows[i] <= cols[j]], j[rows[i] <= cols[j]]
        return pd.DataFrame({"row": rows[i], "col": cols[j], **{s: sums[s][i, j] for s in SUMS}, **{e: ends[e][i, j] for e in ENDS}})

    return run, f"row {kind}, col {kind}, " + ", ".join(f"{c} double" for c in [*SUMS, *ENDS])


def comoments(df: DataFrame, member: str, keys: Sequence[str], value: str, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """row <= col, n, sx, sy, sxx, syy, sxy, x_low, x_high, y_low, y_high of every pair of members that share an observation, members with themselves included.

    Sums are of deviations from each member's mean, so differences of their products keep their digits.
    df has one row for each member and observation (keys); null values are absent.
    """
    seen = df.where(F.col(value).isNotNull()).select(F.col(member).alias("_member"), *keys, F.col(value).cast("double").alias("_x"))
    means = seen.groupBy("_member").agg(F.avg("_x").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    members, total = means.agg(F.count(F.lit(1)), F.sum("_n")).first()
    tiles = max(1, -(-members // tile))
    parts = max(1, -(-(total or 0) * 2 // (rows * tiles)))
    placed = seen.join(means.select("_member", "_mean", F.pmod(F.xxhash64("_member"), F.lit(tiles)).cast("int").alias("_tile")), "_member")
    placed = placed.withColumns({"_x": F.col("_x") - F.col("_mean"), "_part": F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    placed = placed.select("_member", *keys, "_x", "_tile", "_part", F.least("_tile", "_other").alias("_left"), F.greatest("_tile", "_other").alias("_right"))
    run, schema = _products(keys, dict(df.dtypes)[member])
    made = placed.groupBy("_left", "_right", "_part").applyInPandas(run, schema)
    swapped = F.col("row") > F.col("col")  # in pairs of tiles, members come in any order
    turn = {"row": "col", "sx": "sy", "sxx": "syy", "x_low": "y_low", "x_high": "y_high"}
    turn |= {b: a for a, b in turn.items()}
    made = made.select(*[F.when(swapped, F.col(turn.get(c, c))).otherwise(F.col(c)).alias(c) for c in ["row", "col", *SUMS, *ENDS]])
    ends = [F.min(e).alias(e) if e.endswith("low") else F.max(e).alias(e) for e in ENDS]
    return made.groupBy("row", "col").agg(*[F.sum(s).alias(s) for s in SUMS], *ends)


def co_deviation(a: str = "sxy", b: tuple[str, str] = ("sx", "sy")):
    """Sum of products of deviations from the means over the common observations."""
    return F.col(a) - F.col(b[0]) * F.col(b[1]) / F.col("n")
