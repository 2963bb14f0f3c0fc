"""Making this package importable in Python workers on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="tablecheck-code-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(_PACKAGE.rglob("*.py")):
            bundle.write(source, source.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
