"""Makes the package importable in Python workers, wherever it was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per context. Spark serves the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_ridgeline_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="ridgeline-")) / "ridgeline-sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._ridgeline_shipped = True
