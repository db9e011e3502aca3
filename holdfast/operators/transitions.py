"""Conditional updates of the catalog: each takes a version of the catalog and returns the next.

:func:`update` is the one primitive; ``counted`` pairs its result with the number of rows that the
predicate held for, evaluated on the version before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ARCHIVE_PHASES, has, with_flag, without_flag
from .predicates import archivable, in_phase, is_file, is_self_canonical, selected, sparsify_candidate


def update(files: DataFrame, where: Column, **values: Column | str | int | None) -> DataFrame:
    """``files`` with columns replaced where the predicate holds (null does not hold)."""
    holds = F.coalesce(where, F.lit(False))
    new = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return files.select(*(F.when(holds, new[c].cast(files.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns))


def counted(files: DataFrame, where: Column) -> int:
    return files.where(F.coalesce(where, F.lit(False))).count()


def mark_phase(files: DataFrame, id: int, phase: str) -> DataFrame:
    return update(files, F.col("id") == id, phase=phase)


def set_inspection(files: DataFrame, inspected: DataFrame) -> DataFrame:
    """Digests and zero pages from ``inspected(id, sha1, sparse_count)``; those rows become hashed."""
    own = inspected.select(F.col("id").alias("__id"), F.col("sha1").alias("__sha1"), F.col("sparse_count").alias("__sparse"))
    joined = files.join(own, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return update(joined, hit, sha1=F.col("__sha1"), sparse_count=F.col("__sparse"), phase="hashed").select(files.columns)


def apply_filter(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Hashed rows that are selected become filtered; the others get ``exclusion_id`` 1 and are archived
    as entries without payload."""
    keep = selected(include, exclude)
    files = update(files, in_phase("hashed") & ~keep, exclusion_id=1, phase="archived")
    return update(files, in_phase("hashed"), phase="filtered")


def skip_non_files(files: DataFrame) -> DataFrame:
    return update(files, in_phase("filtered") & ~is_file(), phase="deduped")


def skip_missing_digests(files: DataFrame) -> DataFrame:
    return update(files, in_phase("filtered") & F.col("sha1").isNull(), phase="deduped")


def set_canonical(files: DataFrame, elected: DataFrame) -> DataFrame:
    """``elected(id, canonical_id)``: those rows become deduped; a null canonical is kept null."""
    own = elected.select(F.col("id").alias("__id"), F.col("canonical_id").alias("__canonical"))
    joined = files.join(own, F.col("id") == F.col("__id"), "left")
    return update(joined, F.col("__id").isNotNull(), canonical_id=F.col("__canonical"), phase="deduped").select(files.columns)


def clear_checked(files: DataFrame) -> DataFrame:
    return update(files, in_phase("filtered") & has(F.col("flags"), "checked"), flags=without_flag(F.col("flags"), "checked"))


def promote_errored(files: DataFrame) -> DataFrame:
    """Filtered rows with a deduplication error and no canonical become deduped without one."""
    return update(files, in_phase("filtered") & F.col("canonical_id").isNull() & has(F.col("flags"), "dedup_error"), phase="deduped")


def crowded_canonicals(files: DataFrame) -> DataFrame:
    """(sha1, size, n) of groups with more than one filtered row that is its own canonical; there must be none."""
    return files.where(in_phase("filtered") & is_self_canonical()).groupBy("sha1", "size").agg(F.count("*").alias("n")).where("n > 1")


def promote_active_canonicals(files: DataFrame) -> DataFrame:
    """The active canonical of each group becomes deduped; a group may have one at a time."""
    return update(files, in_phase("filtered") & is_self_canonical(), phase="deduped")


def skip_sparsify(files: DataFrame, min_pages: int | None = None) -> DataFrame:
    """Deduped rows that are no candidates become sparsified; without ``min_pages`` all do."""
    where = in_phase("deduped")
    return update(files, where if min_pages is None else where & ~sparsify_candidate(min_pages), phase="sparsified")


def set_sparsified(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``outcomes(id, ok)``: candidates become sparsified with the flag of their outcome."""
    own = outcomes.select(F.col("id").alias("__id"), F.col("ok").alias("__ok"))
    joined = files.join(own, F.col("id") == F.col("__id"), "left")
    flags = F.when(F.col("__ok"), with_flag(F.col("flags"), "has_sparse")).otherwise(with_flag(F.col("flags"), "sparsify_error"))
    return update(joined, F.col("__id").isNotNull(), phase="sparsified", flags=flags).select(files.columns)


def stage(files: DataFrame) -> DataFrame:
    return update(files, in_phase("sparsified"), phase="staged")


def archive_ineligible(files: DataFrame, require_digest: bool = True) -> DataFrame:
    return update(files, in_phase("staged") & ~archivable(require_digest), phase="archived")


def mark_appended(files: DataFrame, ids: DataFrame) -> DataFrame:
    return set_flags(files, ids, "appended")


def archive_appended(files: DataFrame) -> DataFrame:
    return update(files, has(F.col("flags"), "appended"), phase="archived")


def archive_remainder(files: DataFrame) -> DataFrame:
    return update(files, F.col("phase") != "archived", phase="archived")


def clear_pending(files: DataFrame) -> DataFrame:
    """After an aborted session: what was appended but not archived counts as not written."""
    return update(files, has(F.col("flags"), "appended") & (F.col("phase") != "archived"), flags=without_flag(F.col("flags"), "appended"))


def reset_archive(files: DataFrame) -> DataFrame:
    """Back to staged for all that is archived or appended (sessions are wiped beside)."""
    return update(files, in_phase("archived") | has(F.col("flags"), "appended"), phase="staged", flags=without_flag(F.col("flags"), "appended"))


def normalise_installed(files: DataFrame) -> DataFrame:
    """A catalog from an archive, made ready for extraction."""
    files = update(files, F.lit(True), flags=without_flag(F.col("flags"), "extracted"))
    return update(files, F.col("phase").isin(ARCHIVE_PHASES), phase="archived")


def mark_extracted(files: DataFrame, ids: DataFrame) -> DataFrame:
    return set_flags(files, ids, "extracted")


def _content_extracted(files: DataFrame) -> DataFrame:
    """With ``__extracted``: the row or its canonical holds the extracted flag."""
    done = files.where(has(F.col("flags"), "extracted")).select(F.col("id").alias("__c"))
    joined = files.join(done, F.col("canonical_id") == F.col("__c"), "left")
    return joined.withColumn("__extracted", has(F.col("flags"), "extracted") | F.col("__c").isNotNull()).drop("__c")


def _fan_out(files: DataFrame) -> DataFrame:
    """Archived rows whose canonical is unarchived follow it."""
    done = files.where("phase = 'unarchived'").select(F.col("id").alias("__u"))
    joined = files.join(done, F.col("canonical_id") == F.col("__u"), "left")
    return update(joined, in_phase("archived") & F.col("__u").isNotNull(), phase="unarchived").select(files.columns)


def confirm_snapshot(files: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next catalog, rows confirmed directly): archived rows that the snapshot lists as archived and whose
    content is extracted become unarchived; rows whose canonical is unarchived follow."""
    listed = snapshot.where("phase = 'archived'").select(F.col("rel_path").alias("__path")).distinct()
    joined = _content_extracted(files).join(listed, F.col("rel_path") == F.col("__path"), "left")
    where = in_phase("archived") & F.col("__extracted") & F.col("__path").isNotNull()
    return _fan_out(update(joined, where, phase="unarchived").select(files.columns)), joined.where(where).select(files.columns)


def salvage(files: DataFrame) -> DataFrame:
    """End of a trusted scan: all archived rows whose content is extracted become unarchived."""
    return update(_content_extracted(files), in_phase("archived") & F.col("__extracted"), phase="unarchived").select(files.columns)


def verify_rehash(files: DataFrame, rehashed: DataFrame) -> DataFrame:
    """``rehashed(id, sha1)`` of payloads: unarchived rows become rehashed, those whose canonical's digest
    differs get the mismatch flag, those without a digest the error flag."""
    own = rehashed.select(F.col("id").alias("__id"), F.col("sha1").alias("__sha1"))
    joined = files.join(own, F.coalesce(F.col("canonical_id"), F.col("id")) == F.col("__id"), "left")
    flags = F.when(F.col("__sha1").isNull(), with_flag(F.col("flags"), "rehash_error")).when(F.col("__sha1") != F.col("sha1"), with_flag(F.col("flags"), "rehash_mismatch")).otherwise(F.col("flags"))
    return update(joined, in_phase("unarchived") & F.col("__id").isNotNull(), phase="rehashed", flags=flags).select(files.columns)


def place(files: DataFrame, ids: DataFrame) -> DataFrame:
    own = ids.select(F.col("id").alias("__id")).distinct()
    joined = files.join(own, F.col("id") == F.col("__id"), "left")
    return update(joined, in_phase("unarchived", "rehashed") & F.col("__id").isNotNull(), phase="at_destination").select(files.columns)


def fill_names(files: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """User and group names from ``users(uid, name)`` and ``groups(gid, name)``; unknown numbers stay null."""
    u = users.select(F.col("uid").alias("__uid"), F.col("name").alias("__user")).dropDuplicates(["__uid"])
    g = groups.select(F.col("gid").alias("__gid"), F.col("name").alias("__group")).dropDuplicates(["__gid"])
    joined = files.join(u, F.col("uid") == F.col("__uid"), "left").join(g, F.col("gid") == F.col("__gid"), "left")
    return joined.select(*(F.coalesce("__user", F.col(c)).alias(c) if c == "username" else F.coalesce("__group", F.col(c)).alias(c) if c == "groupname" else F.col(c) for c in files.columns))


def set_flags(files: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """A flag for all rows of ``ids(id)``."""
    own = ids.select(F.col("id").alias("__id")).distinct()
    joined = files.join(own, F.col("id") == F.col("__id"), "left")
    return update(joined, F.col("__id").isNotNull(), flags=with_flag(F.col("flags"), name)).select(files.columns)


def set_flag(files: DataFrame, id: int, name: str) -> DataFrame:
    return update(files, F.col("id") == id, flags=with_flag(F.col("flags"), name))


def clear_flag(files: DataFrame, id: int, name: str) -> DataFrame:
    return update(files, F.col("id") == id, flags=without_flag(F.col("flags"), name))


