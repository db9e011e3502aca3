"""Plain reads of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOG, STRIPPED, conform


def open_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A stored catalog; one that is not there yet is empty."""
    from pyspark.errors import AnalysisException

    try:
        return conform(spark.read.parquet(path))
    except AnalysisException:
        return spark.createDataFrame([], CATALOG)


def by_id(files: DataFrame, id: int) -> DataFrame:
    return files.where(F.col("id") == id)


def in_order(files: DataFrame, phase: str, narrow: bool = True) -> DataFrame:
    """Rows of a phase by id, in the narrow projection or whole."""
    rows = files.where(F.col("phase") == phase).orderBy("id")
    return rows.select(STRIPPED) if narrow else rows


def count(files: DataFrame, phase: str | None = None) -> int:
    return (files if phase is None else files.where(F.col("phase") == phase)).count()
