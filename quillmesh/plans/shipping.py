"""Let executors import this package wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per context. Spark distributes the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_quillmesh_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quillmesh-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._quillmesh_shipped = True
