"""Giving executors this package where it is not installed on them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()
# Kept until Python ends: Spark serves the file from here to every executor that joins.
_folder: tempfile.TemporaryDirectory | None = None


def ship(spark: SparkSession, *others: str) -> None:
    """Add the package, and ``others`` beside it, to the Python path of a session's tasks, once.

    Functions that run in tasks are found by name, so every executor must be able to import them.
    """
    global _folder
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    package = Path(__file__).resolve().parent
    _folder = _folder or tempfile.TemporaryDirectory(prefix="civictopics-")
    path = f"{_folder.name}/civictopics-{context.applicationId}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for root in (package, *(package.parent / other for other in others)):
            for file in [root] if root.suffix == ".py" else sorted(root.rglob("*.py")):
                if file.exists():
                    archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _done.add(context.applicationId)
