"""Equal-length windows without a copy for each row.

A code's rows are cut into blocks of some thousand rows in order of date; a block also
holds the length - 1 rows before it, so every window that ends in it lies in it. Tables of
blocks are about as large as the panel. A task turns a block into one array, and its
windows are views of that array: no window is ever stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import table

ROWS = 4096


def window_blocks(df: DataFrame, columns: Sequence[str], length: int, code: str = "stock_code", rows: int = ROWS) -> DataFrame:
    """code, block, steps: written; df is that of window_index, with row_end and window_valid.

    steps are in order of date: (row_end, date, ends, values); ends says whether a valid window ends
    there. A block holds at most rows + length - 1 of them, however many dates a code has.
    """
    if not 1 <= length <= rows + 1:
        raise ValueError("a block must be as long as a window")
    at = F.col("row_end") - 1
    block = F.floor(at / rows)
    values = F.array(*[F.col(c).cast("double") for c in columns])
    homes = F.when(F.pmod(at, F.lit(rows)) >= rows - (length - 1), F.array(block, block + 1)).otherwise(F.array(block))
    placed = df.select(code, "row_end", "date", (block).alias("_home"), "window_valid", values.alias("values"), F.explode(homes).alias("block"))
    step = F.struct("row_end", "date", (F.col("window_valid") & (F.col("block") == F.col("_home"))).alias("ends"), "values")
    made = placed.groupBy(code, "block").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return table(made.where(F.exists("steps", lambda s: s["ends"])), "window_blocks")


def map_windows(blocks: DataFrame, length: int, run: Callable[[object, np.ndarray, np.ndarray], pd.DataFrame], schema: str, code: str = "stock_code") -> DataFrame:
    """run(code, dates, x) of every block, x being windows x length x columns, without copies; what it returns has `schema`."""

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, steps in zip(batch[code], batch["steps"]):
                x = np.array([s["values"] for s in steps], float)
                if len(x) < length:
                    continue
                ends = np.array([s["ends"] for s in steps])[length - 1 :]
                dates = np.array([s["date"] for s in steps], object)[length - 1 :]
                yield run(name, dates[ends], np.lib.stride_tricks.sliding_window_view(x, length, axis=0).transpose(0, 2, 1)[ends])

    return blocks.mapInPandas(serve, schema)
