"""Sends the package to Python workers, for sessions that were started without it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    staged = tempfile.mkdtemp(prefix="spark-")
    shutil.copytree(os.path.join(root, "stratamem"), os.path.join(staged, "tree", "stratamem"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(staged, "stratamem"), "zip", os.path.join(staged, "tree")))
    _sent.add(context.applicationId)
