"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application. Only the driver reads the zip that it is packed into."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    name = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
