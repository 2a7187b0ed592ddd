"""Sessions for local use, and shipping of this package to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cellreach")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless their Python path has it."""
    context = spark.sparkContext
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or ROOT in known:
        return
    archive = Path(tempfile.mkdtemp(prefix="cellreach-")) / "cellreach.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "cellreach").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
