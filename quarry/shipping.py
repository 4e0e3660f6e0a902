"""Gets the package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's files, once, unless PYTHONPATH already leads workers to it."""
    home = Path(__file__).resolve().parent
    if any(p and Path(p).resolve() == home.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(application)
