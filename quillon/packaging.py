"""Sends this package to the executors of a session that wasn't started with it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    here = Path(__file__).resolve().parent
    context = spark.sparkContext
    if context.applicationId in _sent or context.master.split("[")[0] == "local":  # there, workers share the driver's path
        return
    target = Path(tempfile.mkdtemp(prefix="quillon-")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
