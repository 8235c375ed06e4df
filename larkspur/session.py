"""SparkSession factory, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Rows of an Arrow batch, unless the session names a number: Spark's 10,000 whole texts take too much of a small executor.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def get_spark(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once a context, so that Arrow functions can import it there.

    Also has Arrow batches hold BATCH rows if the session says nothing of them.
    """
    context = spark.sparkContext
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    if not any(name.startswith("larkspur-") for name in context._python_includes):
        handle, path = tempfile.mkstemp(prefix="larkspur-", suffix=".zip")
        with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(PACKAGE.rglob("*.py")):
                archive.write(source, source.relative_to(PACKAGE.parent))
        context.addPyFile(path)
    return spark
