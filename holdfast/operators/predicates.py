"""Null-safe predicates on catalog rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..schema import SESSION_OPEN, has


def _sure(predicate: Column) -> Column:
    """Null counts as false, so a predicate and its negation part all rows."""
    return F.coalesce(predicate, F.lit(False))


def is_file() -> Column:
    return _sure(F.col("ftype") == "file")


def is_self_canonical() -> Column:
    return _sure(F.col("canonical_id") == F.col("id"))


def in_phase(*phases: str) -> Column:
    return F.col("phase").isin(list(phases))


def sparsify_candidate(min_pages: int) -> Column:
    return is_self_canonical() & is_file() & F.col("sha1").isNotNull() & _sure(F.col("sparse_count") >= min_pages) & ~has(F.col("flags"), "has_sparse")


def archivable(require_digest: bool = True) -> Column:
    """Whether a row's content is a payload of the archive."""
    ok = is_self_canonical() & is_file()
    return ok & F.col("sha1").isNotNull() if require_digest else ok


def electable() -> Column:
    """Still to be deduplicated and fit to be canonical."""
    return in_phase("filtered") & F.col("canonical_id").isNull() & ~has(F.col("flags"), "dedup_error")


def session_open() -> Column:
    return F.col("finalized") == SESSION_OPEN


def changed_since(before: str = "stored", now: str = "current") -> Column:
    """Whether a time differs by whole seconds; a time missing on either side tells nothing."""
    differs = lambda c: _sure(F.date_trunc("second", F.col(f"{before}.{c}")) != F.date_trunc("second", F.col(f"{now}.{c}")))
    return reduce(Column.__or__, map(differs, ("mtime", "atime", "ctime")))


def _glob(pattern: str) -> str:
    """Regular expression of a shell pattern: * and ? stay within a part, ** crosses parts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r"\.^$+{}()|]" else c)
        i += 1
    return out


def matches_any(path: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Whether a path, one of its last parts, or a directory above it matches a shell pattern."""
    if not patterns:
        return F.lit(False)
    body = "|".join(_glob(p.rstrip("/")) for p in patterns)
    return path.rlike(("(?i)" if ignore_case else "") + f"^(?:.*/)?(?:{body})(?:/.*)?$")


def selected(include: list[str] = (), exclude: list[str] = (), ignore_case: bool = False) -> Column:
    """Rows that an include pattern matches (all, without any) and no exclude pattern does."""
    path = F.col("rel_path")
    chosen = matches_any(path, list(include), ignore_case) if include else F.lit(True)
    return chosen & ~matches_any(path, list(exclude), ignore_case)


def newer_than(files: DataFrame, moment: str) -> DataFrame:
    return files.where(F.col("mtime") > F.lit(moment).cast("timestamp"))


def cached_payload_ids(listing: DataFrame) -> DataFrame:
    """Ids of the payloads whose member names are in ``listing(name)``."""
    from ..functions.content import parse

    return listing.select(parse(basename(F.col("name")))["id"].alias("id")).where("id is not null").distinct()
