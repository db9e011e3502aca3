"""What to restore, and from which payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import member_name
from ..functions.paths import is_safe
from .predicates import in_phase, is_file, is_self_canonical


def restore_plan(files: DataFrame, phases: tuple[str, ...] = ("unarchived", "rehashed")) -> DataFrame:
    """(id, rel_path, canonical_id, member, size, mtime, mode, uid, gid, xattr, acl, safe) of every file to place; copies
    find the payload of their canonical."""
    payloads = files.where(is_self_canonical() & is_file()).select(F.col("id").alias("__c"), member_name().alias("member"))
    wanted = files.where(in_phase(*phases) & is_file())
    joined = wanted.join(payloads, F.col("canonical_id") == F.col("__c"))
    return joined.select("id", "rel_path", "canonical_id", "member", "size", "mtime", "mode", "uid", "gid", "xattr", "acl", is_safe(F.col("rel_path")).alias("safe"))


def without_payload(files: DataFrame, phases: tuple[str, ...] = ("unarchived", "rehashed")) -> DataFrame:
    """Files to place whose canonical is no payload."""
    payloads = files.where(is_self_canonical() & is_file() & F.col("sha1").isNotNull()).select(F.col("id").alias("__c"))
    return files.where(in_phase(*phases) & is_file()).join(payloads, F.col("canonical_id") == F.col("__c"), "left_anti")


def unrestored(files: DataFrame) -> DataFrame:
    """Regular files that no pattern left out and that no payload can restore: their content was never read, their
    canonical is no payload, or nothing vouches for it."""
    wanted = files.where(is_file() & F.col("exclusion_id").isNull())
    waiting = wanted.where(~in_phase("unarchived", "rehashed", "at_destination", "permissions_restored"))
    return waiting.unionByName(without_payload(wanted))


def stage_plan(files: DataFrame, root: str, sparse_dir: str) -> DataFrame:
    """(id, member, source): which file becomes which member; sparse ones come from the sparse copies."""
    rows = files.where(is_self_canonical() & is_file() & F.col("sha1").isNotNull())
    sparse = F.col("flags").bitwiseAND(F.lit(4)) != 0
    source = F.when(sparse, F.concat(F.lit(sparse_dir.rstrip("/") + "/"), member_name())).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("rel_path")))
    return rows.select("id", member_name().alias("member"), source.alias("source"), "ext", "size", "phase")
