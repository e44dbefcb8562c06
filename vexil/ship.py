"""Give executors this package where it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's executors, once a context; nothing to do where PYTHONPATH has them."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_vexil_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="vexil-ship-")) / "vexil.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "vexil").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._vexil_shipped = True
