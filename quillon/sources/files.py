"""Files as rows: their metadata without their content, small texts, and texts written to given places."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name, modified, length of every file below a folder; no content is read.

    As everywhere in Spark, files without bytes and names (or folders) that begin with _ or . aren't seen: a file that
    must not be empty then counts as missing, and caches such as __pycache__ are out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, text of the files whose name fits, such as logs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def below(path, folder: str):
    """The part of a path under a folder, whatever its scheme."""
    return F.substring_index(path, f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's path or address, and its path there."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_texts(df: DataFrame, folder: str) -> None:
    """df: path (below the folder), text. Each task writes its rows, one file each; a task that runs again writes the same."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                fs.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield batch[["path"]]

    df.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
