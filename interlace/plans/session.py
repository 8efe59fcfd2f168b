"""What a session needs before operators with Python stages run in it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_interlace_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"  # on the driver only; Spark hands it out from there
    with zipfile.ZipFile(path, "w") as packed:
        for source in sorted(PACKAGE.rglob("*.py")):
            packed.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._interlace_shipped = True
