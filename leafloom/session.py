"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "leafloom", **conf: str) -> SparkSession:
    """A session with the settings the plans expect: adaptive execution and UTC."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers: nothing to do where PYTHONPATH has it, else its archive is added
    to the application once."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) not in on_path and app not in _shipped and root.is_dir():
        to = tempfile.mkdtemp()
        shutil.copytree(Path(__file__).parent, f"{to}/pkg/leafloom", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/leafloom", "zip", f"{to}/pkg"))
        _shipped.add(app)
    return spark


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Sends rows to Python in batches of 1,000 where the session has the default of 10,000: rows are whole texts here."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """A folder that all nodes share: ``spark.checkpoint.dir``, else one below the warehouse, or for a local master one in the
    temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
