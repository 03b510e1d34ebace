"""Send the package to the executors of a session that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application's Python files, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    path = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)
