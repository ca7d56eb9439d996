"""Make this package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources as a zip file, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped_to:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="presswell-src-")
    target = os.path.join(folder, "presswell_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.join("presswell", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped_to.add(app)
