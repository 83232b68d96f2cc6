"""Send this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Let every executor import the package, however the driver found it; once per Spark context.

    The driver zips its own copy and Spark's file server hands it to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    bundle = Path(tempfile.mkdtemp(prefix="logloom-")) / "logloom_package.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(bundle))
    context._logloom_shipped = True
