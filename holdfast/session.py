"""Session helpers shared by the entry points."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable by Python workers where their path does not hold it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    fd, name = tempfile.mkstemp(prefix="holdfast-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((ROOT / "holdfast").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(name)


def checkpointed(df):
    """``df`` cut from its lineage in the folder that all executors share (``spark.checkpoint.dir``). Only a
    session in one process, as in tests, may go without the setting and gets a private folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise ValueError("a cluster must name the folder that executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="holdfast-checkpoint-"))
    return df.checkpoint()
