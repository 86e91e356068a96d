"""Readies a session for the Python operators: ships this package to the workers and bounds the bytes of an Arrow batch."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: By default a batch is bounded by rows, which says nothing about memory when texts are long.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context's Python files, once; sets the batch's bound unless the session has one."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
