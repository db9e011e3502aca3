"""Writes by key on immutable tables: insert if absent, upsert, delete, and the sessions' log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SESSION_ABORTED, SESSION_FINALIZED, SESSION_OPEN
from .transitions import clear_pending, update


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the least ``order`` (a grouped minimum, so equal keys are summed first)."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str = "rel_path", order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(all rows, inserted rows): of the new rows the first of each key that is not there yet."""
    inserted = first_by_key(new, key, order).select(existing.columns).join(existing.select(key), key, "left_anti").select(existing.columns)
    return existing.unionByName(inserted), inserted


def upsert(existing: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return existing.join(new.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def delete(existing: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti").select(existing.columns)


def meta_value(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return row.value if row else None


def meta_dump(meta: DataFrame) -> DataFrame:
    """All of the metadata by key."""
    return meta.select("key", "value").orderBy("key")


def clear_meta(meta: DataFrame, prefix: str = "") -> DataFrame:
    """Without the keys that begin so (without any, by default)."""
    return meta.where(~F.col("key").startswith(prefix))


def begin_session(sessions: DataFrame, archive_offset: int) -> DataFrame:
    number = sessions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = number.select(F.col("id").cast("long"), F.lit(archive_offset).cast("long").alias("archive_offset"), F.lit(SESSION_OPEN).alias("finalized"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return sessions.unionByName(row)


def _close(sessions: DataFrame, id: int, state: int) -> DataFrame:
    return update(sessions, (F.col("id") == id) & (F.col("finalized") == SESSION_OPEN), finalized=state, finished_at=F.current_timestamp())


def stamp_session(sessions: DataFrame, id: int) -> DataFrame:
    return _close(sessions, id, SESSION_OPEN)


def finalize_session(sessions: DataFrame, id: int) -> DataFrame:
    return _close(sessions, id, SESSION_FINALIZED)


def abort_session(sessions: DataFrame, id: int) -> DataFrame:
    return _close(sessions, id, SESSION_ABORTED)


def recover(sessions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """Start after a crash: the latest open session is aborted and its unconfirmed members are pending
    again. Returns the offset to cut the archive at, None if no session was open."""
    latest = sessions.where(F.col("finalized") == SESSION_OPEN).orderBy(F.desc("id")).first()
    if latest is None:
        return sessions, files, None
    return abort_session(sessions, latest.id), clear_pending(files), latest.archive_offset
