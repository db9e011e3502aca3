"""Comparisons of files on the file system that all executors share."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import changed_since

CHUNK = 1 << 20
TIMES = ("mtime", "atime", "ctime")


def same_bytes(left: str, right: str) -> bool:
    """Whether two files hold the same bytes; an OSError's ``filename`` says which could not be read."""
    def chunks(path: str) -> Iterator[bytes]:
        try:
            with open(path, "rb") as f:
                while part := f.read(CHUNK):
                    yield part
        except OSError as e:
            e.filename = path
            raise
        yield b""

    for a, b in zip(chunks(left), chunks(right)):
        if a != b:
            return False
    return True


def compare_files(pairs: DataFrame) -> DataFrame:
    """``pairs(canonical, candidate, path, __path)``, the candidate's path and the canonical's, -> (canonical,
    candidate, equal, side): whether they hold the same bytes, or the id whose file could not be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            equal, side = [], []
            for c, d, path, head in zip(*(b.column(x).to_pylist() for x in ("canonical", "candidate", "path", "__path"))):
                try:
                    equal.append(same_bytes(head, path))
                    side.append(None)
                except OSError as e:
                    equal.append(False)
                    side.append(c if e.filename == head else d)
            yield pa.RecordBatch.from_arrays([b.column("canonical"), b.column("candidate"), pa.array(equal, pa.bool_()), pa.array(side, pa.int64())], ["canonical", "candidate", "equal", "side"])

    return pairs.select("canonical", "candidate", "path", "__path").mapInArrow(run, "canonical long, candidate long, equal boolean, side long")


def live_times(paths: DataFrame) -> DataFrame:
    """``paths(id, path)`` -> (id, found, mtime, atime, ctime) as the file system has them now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = lambda ns: datetime.fromtimestamp(ns // 10**9, timezone.utc).replace(microsecond=ns % 10**9 // 1000)
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                try:
                    s = os.stat(path)
                    rows.append((True, time(s.st_mtime_ns), time(s.st_atime_ns), time(s.st_birthtime_ns) if hasattr(s, "st_birthtime_ns") else None))
                except OSError:
                    rows.append((False, None, None, None))
            kinds = [pa.bool_(), *[pa.timestamp("us", "UTC")] * 3]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(4))], ["id", "found", *TIMES])

    return paths.select(F.col("id").cast("long"), "path").mapInArrow(run, "id long, found boolean, mtime timestamp, atime timestamp, ctime timestamp")


def changed_files(files: DataFrame, path: Column) -> DataFrame:
    """(id, rel_path, problem) of the files that are gone, or whose times are not those of the inventory."""
    now = live_times(files.select("id", path.alias("path"))).select(F.col("id").alias("__id"), "found", F.struct(*TIMES).alias("current"))
    both = files.select("id", "rel_path", F.struct(*TIMES).alias("stored")).join(now, F.col("id") == F.col("__id"))
    problem = F.when(~F.col("found"), "gone").when(changed_since(), "changed since the inventory")
    return both.select("id", "rel_path", problem.alias("problem")).where("problem is not null")
