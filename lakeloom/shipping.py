"""Sending this package to the executors, whose Python may not have it."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).parent
_sent: set[str] = set()


@functools.lru_cache(1)
def _archive() -> str:
    path = f"{tempfile.mkdtemp()}/{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once. Spark copies the archive from the driver to the executors."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        spark.sparkContext.addPyFile(_archive())
        _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        ship(spark)
        return query(spark, directory)

    return run
