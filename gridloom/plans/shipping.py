"""Make the package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import gridloom

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Functions of the package then travel by name, so what a worker caches in
    a module outlives a task.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(gridloom.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="gridloom-ship-")) / "gridloom_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
