"""The archive scan as relations: members, snapshots, provenance.

A scan reads members in order. What it decides is set-based here: a member after the k-th snapshot is
confirmed by the first later snapshot that lists it, whatever the number of members.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import parse
from ..functions.paths import basename, clean
from ..schema import MANIFEST, SNAPSHOT


class ScanError(ValueError):
    """A member that an archive of this kind can't hold at its place."""


def members(df: DataFrame) -> DataFrame:
    """``df(member_index, name, ...)`` with kind (manifest, snapshot, payload, other) and payload_id."""
    name = basename(clean(F.col("name")))
    parsed = parse(name)
    kind = F.when(name == MANIFEST, "manifest").when(name == SNAPSHOT, "snapshot").when(parsed.isNotNull(), "payload").otherwise("other")
    return df.withColumn("kind", kind).withColumn("payload_id", parsed["id"])


def misplaced(df: DataFrame, force: bool = False) -> DataFrame:
    """(member_index, name, problem) of members that stop a scan; ``df`` may come from :func:`members`."""
    rows = df if "kind" in df.columns else members(df)
    first = F.col("member_index") == 0
    problem = (
        F.when(F.col("kind") == "other", "neither a catalog nor a content id")
        .when((F.col("kind") == "manifest") & ~first, "the manifest is not the first member")
        .when(first & (F.col("kind") != "manifest") & F.lit(not force), "the first member is no manifest")
    )
    return rows.select("member_index", "name", problem.alias("problem")).where("problem is not null")


def confirmations(df: DataFrame) -> DataFrame:
    """(payload_id, member_index, snapshot_index): for each payload member the next snapshot, null if none.

    Members are range-partitioned in the order of archive and index; the first snapshot of every partition is
    what the partitions before it look ahead to, so no archive is one task's whole."""
    from ..session import checkpointed

    own = members(df).withColumn("__archive", F.coalesce(F.col("archive") if "archive" in df.columns else F.lit(None), F.lit("")).cast("string"))
    mark = F.when(F.col("kind") == "snapshot", F.col("member_index"))
    dealt = checkpointed(own.repartitionByRange("__archive", "member_index").withColumn("__part", F.spark_partition_id()))
    firsts = dealt.where(mark.isNotNull()).groupBy("__archive", "__part").agg(F.min(mark).alias("__first"))
    # of every partition and archive the first snapshot after it: at most one row for both of them
    later = firsts.select(F.col("__archive").alias("__a"), F.col("__part").alias("__p"), F.col("__first").alias("__f"))
    parts = dealt.select("__archive", "__part").distinct()
    beyond = parts.join(later, (F.col("__archive") == F.col("__a")) & (F.col("__p") > F.col("__part"))).groupBy("__archive", "__part").agg(F.min("__f").alias("__next"))
    ahead = Window.partitionBy("__part", "__archive").orderBy(F.desc("member_index")).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__here", F.min(mark).over(ahead)).join(beyond, ["__archive", "__part"], "left")
    out = placed.withColumn("snapshot_index", F.coalesce("__here", "__next")).where("kind = 'payload'")
    return out.select("payload_id", "member_index", "snapshot_index", *(["archive"] if "archive" in df.columns else []))


@dataclass(frozen=True)
class ScanState:
    """What a resumable scan remembers."""

    saw_manifest: bool = False
    saw_any: bool = False
    complete: bool = False
    last_index: int | None = None
    from_footer: bool = False
    snapshots: int = 0

    def merge(self, now: ScanState) -> ScanState:
        """Saved state with what a further scan saw: the furthest place and either's findings."""
        places = [x for x in (self.last_index, now.last_index) if x is not None]
        return ScanState(self.saw_manifest or now.saw_manifest, self.saw_any or now.saw_any, now.complete, max(places, default=None), self.from_footer or now.from_footer, max(self.snapshots, now.snapshots))

    def next_index(self) -> int:
        """The first member that is still to be read."""
        return 0 if self.last_index is None else self.last_index + 1

    def seen(self, index: int, kind: str) -> ScanState:
        return replace(self, saw_any=True, saw_manifest=self.saw_manifest or kind == "manifest", last_index=index, snapshots=self.snapshots + (kind == "snapshot"))


#: What a finished scan means, by (manifest, snapshot, footer).
OUTCOMES = {
    (False, False, False): "resumed without provenance",
    (False, False, True): "footer without snapshot",
    (False, True, False): "snapshots without manifest or footer",
    (False, True, True): "footer and snapshots without manifest",
    (True, False, False): "manifest without snapshot",
    (True, False, True): "manifest and footer without snapshot",
    (True, True, False): "complete",
    (True, True, True): "complete with footer",
}


def outcome(state: ScanState, resumed: bool = False) -> str:
    key = (state.saw_manifest, state.snapshots > 0, state.from_footer)
    if key == (False, False, False) and not resumed:
        raise ScanError("a scan ended without any catalog")
    return OUTCOMES[key]


def outcome_column(manifest: Column, snapshots: Column, footer: Column, resumed: Column) -> Column:
    """:func:`outcome` for rows of scan states; null where a scan ended without any catalog."""
    out = F
    for (m, s, f), label in OUTCOMES.items():
        test = (manifest == m) & ((snapshots > 0) == s) & (footer == f)
        out = out.when(test & resumed if not (m or s or f) else test, label)
    return out.otherwise(F.lit(None).cast("string"))


def completeness(counts, from_footer: bool, force: bool = False) -> list[str]:
    """Warnings on the counts of ``reports.extraction_counts``; missing payloads are an error unless forced."""
    out = []
    if counts.missing:
        text = f"payloads of {counts.missing} canonical file(s) are not in the archive, though the catalog has them as written"
        if not force:
            raise ScanError(text)
        out.append(text)
    n = counts.unconfirmed
    if n and from_footer:
        out.append(f"no snapshot vouches for {n} file(s); they rest on the footer's catalog alone")
    elif n and counts.confirmed:
        out.append(f"no snapshot vouches for {n} file(s); the end of the archive seems to be cut off")
    elif n:
        out.append(f"no snapshot vouches for any of {n} file(s); most of the archive seems to be missing")
    return out
