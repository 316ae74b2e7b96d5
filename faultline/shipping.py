"""Sends the package to the executors, whose Python workers import it when they run a function of ours."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "faultline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(path)
    _SENT.add(context.applicationId)
