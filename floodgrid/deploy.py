"""Sends the package to the executors, so that tasks can import it wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package, zipped, to the session's Python files; once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_floodgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "copy")
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        served = tempfile.mkdtemp()  # executors fetch it from the driver as long as that runs
        atexit.register(shutil.rmtree, served, ignore_errors=True)
        file = shutil.make_archive(str(Path(served, root.name)), "zip", copy)
    context.addPyFile(file)
    context._floodgrid_shipped = True
