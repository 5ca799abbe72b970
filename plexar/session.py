"""A session with the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, so that they need no copy of it
    on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder, root = tempfile.mkdtemp(), Path(__file__).parent
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/plexar_modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def session(master: str = "local[*]", app: str = "plexar", **conf: str) -> SparkSession:
    """UTC, adaptive execution, skew handling; keyword settings use __ for the dots."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
