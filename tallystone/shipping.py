"""Sends this package to the Python workers of a session, which may not have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package's modules, which Spark's own file server hands to all executors."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package itself came in an archive, which whoever sent it has sent everywhere
        folder = tempfile.mkdtemp(prefix="tallystone")  # on the driver only, which serves the file; gone at its end
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "tallystone.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(str(target))
    _sent.add(sc.applicationId)


#: Rows and bytes of an Arrow batch of texts. Spark's defaults, 10,000 rows and 64 MB, are for short rows: a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Gets Python workers ready for texts: what a worker holds is bounded by a batch, however large the table."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # rows of 0 or -1: unbounded
            spark.conf.set(key, str(most))
