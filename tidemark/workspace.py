"""What the driver and all executors share: a folder, and this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is named."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(found)
    return found


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, whatever their working folder.

    Where executors don't see the driver's folders, submit the package with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
