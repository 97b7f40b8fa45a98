"""Sends this package to the executors' Python workers, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package goes out with addPyFile."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    package = Path(__file__).resolve().parent.parent
    if not package.is_dir():  # imported from a zip: already shipped
        return
    target = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
