"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each context. Safe to call often."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="lumenrank-")
        atexit.register(shutil.rmtree, folder, True)
        target = os.path.join(folder, "lumenrank_ship.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark
