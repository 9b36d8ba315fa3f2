"""Claim-integrity analytics on Spark, and operators of a training-data pipeline in the subpackage ``llm``."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors' Python, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="auditspark-zip-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        inside = os.path.join(folder, "in", "auditspark")
        shutil.copytree(root, inside, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "auditspark_code"), "zip", os.path.dirname(inside)))
