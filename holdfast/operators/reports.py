"""Aggregates over the catalog. Each returns a DataFrame; none needs more than one grouped shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SESSION_FINALIZED, has
from .predicates import archivable, electable, in_phase, is_file, is_self_canonical, session_open
from .transitions import _content_extracted


def phase_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("phase").agg(F.count("*").alias("n"))


def pending_groups(files: DataFrame) -> DataFrame:
    """Content groups of several rows, one at least still filtered."""
    waiting = F.sum(F.when(F.col("phase") == "filtered", 1).otherwise(0))
    return files.where("sha1 is not null").groupBy("sha1", "size").agg(F.count("*").alias("n"), waiting.alias("waiting")).where("n > 1 and waiting > 0")


def singletons(files: DataFrame) -> DataFrame:
    """Filtered rows whose content group, over all phases and types, is themselves alone."""
    alone = files.where("sha1 is not null").groupBy("sha1", "size").agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return files.where(in_phase("filtered")).join(alone, ["sha1", "size"], "left_semi").select(files.columns)


def dedup_progress(files: DataFrame) -> DataFrame:
    """Active canonicals, electable rows and rows that still hold the checked flag."""
    active = in_phase("filtered") & is_self_canonical()
    return files.agg(F.count_if(active).alias("active"), F.count_if(electable()).alias("electable"), F.count_if(has(F.col("flags"), "checked")).alias("checked"))


def canonical_bytes(files: DataFrame, require_digest: bool = True) -> DataFrame:
    """Bytes of payloads to archive (staged or archived) and of those archived."""
    rows = files.where(archivable(require_digest))
    total = lambda *p: F.coalesce(F.sum(F.when(in_phase(*p), F.col("size"))), F.lit(0)).cast("long")
    return rows.agg(total("staged", "archived").alias("to_archive"), total("archived").alias("archived"))


def bytes_saved(files: DataFrame) -> DataFrame:
    """What deduplication saves: rows, copies, bytes, bytes of copies."""
    copy = F.coalesce(F.col("canonical_id") != F.col("id"), F.lit(False)) & is_file()
    return files.agg(F.count("*").alias("n_rows"), F.count_if(copy).alias("n_copies"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.sum(F.when(copy, F.col("size"))), F.lit(0)).cast("long").alias("saved"))


def extraction_counts(files: DataFrame) -> DataFrame:
    """Missing payloads, unconfirmed rows, extracted canonicals and extracted paths."""
    rows = _content_extracted(files)
    appended, extracted = has(F.col("flags"), "appended"), has(F.col("flags"), "extracted")
    return rows.agg(
        F.count_if(is_self_canonical() & appended & ~extracted).alias("missing"),
        F.count_if(in_phase("archived") & F.col("__extracted")).alias("unconfirmed"),
        F.count_if(is_self_canonical() & extracted).alias("extracted_canonical"),
        F.count_if(F.col("__extracted")).alias("extracted_paths"),
        F.count_if(in_phase("unarchived")).alias("confirmed"),
    )


def non_appended_by_type(files: DataFrame) -> DataFrame:
    """Entries without payload by file type, null as 'null'."""
    return files.where(~has(F.col("flags"), "appended")).groupBy(F.coalesce("ftype", F.lit("null")).alias("ftype")).agg(F.count("*").alias("n")).orderBy("ftype")


def bytes_to_restore(files: DataFrame) -> DataFrame:
    return files.where(in_phase("unarchived")).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))


def sparsify_tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def distinct_owners(files: DataFrame) -> DataFrame:
    """Distinct user and group numbers."""
    return files.select(F.inline(F.array(F.struct(F.lit("user").alias("kind"), F.col("uid").alias("number")), F.struct(F.lit("group").alias("kind"), F.col("gid").alias("number"))))).where("number is not null").distinct()


def latest_open_session(sessions: DataFrame) -> DataFrame:
    return sessions.where(session_open()).orderBy(F.desc("id")).limit(1)


def has_finalized_session(sessions: DataFrame) -> bool:
    return bool(sessions.where(F.col("finalized") == SESSION_FINALIZED).limit(1).count())


def packing_order(files: DataFrame, require_digest: bool = True) -> DataFrame:
    """Payloads to write, by extension, size and id (the order of the archive)."""
    return files.where(in_phase("staged") & archivable(require_digest)).orderBy("ext", "size", "id")
