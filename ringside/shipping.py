"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session; operators with Python tasks call it themselves."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        into = os.path.join(tempfile.mkdtemp(prefix="ringside-"), package.name)
        context.addPyFile(shutil.make_archive(into, "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)
