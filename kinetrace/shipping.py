"""Makes the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of rows that go to a Python worker at once, unless the session says otherwise; Spark's default is 64 MB.
BATCH, KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to the session's executors, once per context; the driver serves them, wherever executors run."""
    if spark.conf.get(KEY) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(KEY, str(BATCH))
    context = spark.sparkContext
    if getattr(context, "_kinetrace_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="kinetrace-")) / "kinetrace.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(str(path))
    context._kinetrace_shipped = True
