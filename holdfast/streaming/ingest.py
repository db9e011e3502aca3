"""Incremental ingestion of archive members as a structured stream.

Member events arrive as Parquet files in a folder; each micro-batch moves the catalog one version on:
payloads become extracted, a snapshot confirms what was extracted before it. Versions are folders named by
batch, written before the state that points at them, so a batch that is run again after a failure writes
the same version again.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transitions as tr
from ..operators.scan import ScanState, members

#: archive order, member name; for snapshots also the paths they list as archived
EVENTS = "member_index long, name string, listed array<string>"


class Ingest:
    """The catalog's versions and the scan's state in ``folder`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.state_path = os.path.join(folder, "state.json")

    def start(self, catalog: DataFrame) -> None:
        if not os.path.exists(self.state_path):
            os.makedirs(self.folder, exist_ok=True)
            tr.normalise_installed(catalog).write.mode("overwrite").parquet(os.path.join(self.folder, "catalog-start"))
            self._save("start", -1, ScanState())

    def _save(self, version: str, batch: int, state: ScanState) -> None:
        with open(self.state_path + ".new", "w") as f:
            json.dump({"version": version, "batch": batch, "state": vars(state)}, f)
        os.replace(self.state_path + ".new", self.state_path)

    def load(self) -> tuple[DataFrame, ScanState, int]:
        with open(self.state_path) as f:
            saved = json.load(f)
        return self.spark.read.parquet(os.path.join(self.folder, f"catalog-{saved['version']}")), ScanState(**saved["state"]), saved["batch"]

    def batch(self, events: DataFrame, number: int) -> None:
        """One micro-batch: runs of payloads between snapshots, in member order."""
        files, state, done = self.load()
        if number <= done:
            return
        rows = members(events.where(F.col("member_index") >= state.next_index()))
        marks = [r.member_index for r in rows.where("kind = 'snapshot'").select("member_index").orderBy("member_index").collect()]
        manifest = bool(rows.where("kind = 'manifest'").limit(1).count())
        last = rows.agg(F.max("member_index")).first()[0]
        before = -1
        for at in marks:
            files = tr.mark_extracted(files, rows.where((F.col("kind") == "payload") & F.col("member_index").between(before, at)).select(F.col("payload_id").alias("id")))
            listed = rows.where(F.col("member_index") == at).select(F.explode("listed").alias("rel_path"), F.lit("archived").alias("phase"))
            files, _ = tr.confirm_snapshot(files, listed)
            before = at
        files = tr.mark_extracted(files, rows.where((F.col("kind") == "payload") & (F.col("member_index") > before)).select(F.col("payload_id").alias("id")))
        files.write.mode("overwrite").parquet(os.path.join(self.folder, f"catalog-{number}"))
        seen = ScanState(manifest, last is not None, False, last, False, state.snapshots + len(marks))
        self._save(str(number), number, state.merge(seen))

    def run(self, source: str) -> None:
        """All files that are in ``source`` now, as a stream with a checkpoint."""
        stream = self.spark.readStream.schema(EVENTS).parquet(source)
        stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", os.path.join(self.folder, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
