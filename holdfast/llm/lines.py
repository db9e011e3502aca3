"""Line deduplication by overlapping windows of three lines.

A text's lines are its parts between ``\\n``. Every three consecutive lines that hold a non-blank byte
form a window; a window that also stands in a document of a smaller doc_id, or earlier in the same
document, is a later occurrence, and all lines that later occurrences cover are removed.

Only 128-bit window hashes travel: they are reduced to the smallest and largest document per window (with
map-side combining, so a window in a third of all documents is no hot key), windows of one document are
dropped, and the rest joins back to its places. Repeats inside a document are found in place.

Defined cases: null text has no lines and stays null; an empty text has one empty line; texts of fewer
than three lines have no window; a null doc_id ranks after all others; rows of one doc_id don't precede
each other (only places inside one row do); further columns are ignored, or kept by :func:`dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import SPACE, chunks, covered, hash_words, mix, roll, signed, text_key, texts

LINES = 3
LAST = (1 << 63) - 1


def line_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines and the line offsets of each text."""
    breaks = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(breaks, offs)) + 1
    line_offs = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(line_offs[-1], np.int64), np.empty(line_offs[-1], np.int64)
    first, last = np.zeros(line_offs[-1], bool), np.zeros(line_offs[-1], bool)
    first[line_offs[:-1]], last[line_offs[1:] - 1] = True, True
    starts[first], starts[~first] = offs[:-1], breaks + 1
    ends[last], ends[~last] = offs[1:], breaks
    return starts, ends, line_offs


def windows(data: np.ndarray, offs: np.ndarray, width: int):
    """First lines of the windows with two 64-bit hashes each; the line offsets and bounds."""
    starts, ends, line_offs = line_bounds(data, offs)
    h, other = hash_words(data, starts, ends), hash_words(data, starts, ends, 1)
    ink = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = np.concatenate([[0], np.cumsum(ink[ends] > ink[starts])])
    at = np.flatnonzero(full[width:] > full[:-width]) if len(full) > width else np.zeros(0, np.int64)
    text = np.searchsorted(line_offs, at, "right") - 1
    at = at[at + width <= line_offs[text + 1]] if len(at) else at
    one, two = mix(roll(h, width)), mix(roll(other, width))
    return at, one[at], two[at], line_offs, starts, ends


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                at, one, two, line_offs, _, _ = windows(c.data, c.offs, width)
                text = np.searchsorted(line_offs, at, "right") - 1
                take = pa.array(text + c.first)
                yield pa.RecordBatch.from_arrays([pa.array(signed(one)), pa.array(signed(two)), b.column("__hf_d").take(take), b.column("__hf_k").take(take), pa.array((at - line_offs[text]).astype(np.int32))], ["w1", "w2", "d", "k", "at"])

    return run


def later_windows(docs: DataFrame, width: int = LINES) -> DataFrame:
    """(d, k, at): the places of windows that a document of a smaller id has too, at list by row."""
    places = docs.mapInArrow(_windows(width), "w1 long, w2 long, d long, k long, at int")
    shared = places.groupBy("w1", "w2").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    return places.join(shared.select("w1", "w2", "least"), ["w1", "w2"]).where("d > least").groupBy("d", "k").agg(F.collect_set("at").alias("at"))


def removed(data: np.ndarray, offs: np.ndarray, at: pa.Array, width: int):
    """Booleans of a chunk's lines that later occurrences cover; at: the global ones by text."""
    where, one, two, line_offs, starts, ends = windows(data, offs, width)
    text = np.searchsorted(line_offs, where, "right") - 1
    order = np.lexsort((where, two, one, text))
    t, x, y = text[order], one[order], two[order]
    again = np.concatenate([[False], (t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])]) if len(order) else np.zeros(0, bool)
    size = np.asarray(at.value_lengths().fill_null(0), np.int64)
    begin = np.concatenate([where[order[again]], np.asarray(at.flatten(), np.int64) + np.repeat(line_offs[:-1], size)])
    return covered(int(line_offs[-1]), begin, np.full(len(begin), width)), line_offs, starts, ends


def _joined(docs: DataFrame, width: int) -> DataFrame:
    keyed = docs.withColumns({"__hf_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__hf_k": text_key(F.col("text"))})
    narrow = keyed.select("__hf_d", "__hf_k", F.col("text").cast("string").alias("text")).where("text is not null")
    hits = later_windows(narrow, width).select(F.col("d").alias("__hf_d"), F.col("k").alias("__hf_k"), F.col("at").alias("__hf_at"))
    return keyed.join(hits, ["__hf_d", "__hf_k"], "left")


def _kept(c, at: pa.Array, width: int) -> Iterator[tuple[int, int, str]]:
    """(lines, removed lines, kept text) of each row of a chunk."""
    gone, line_offs, starts, ends = removed(c.data, c.offs, at, width)
    raw, n = c.data.tobytes(), np.diff(line_offs)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[line_offs])
    for i in range(c.rows):
        if not lost[i]:
            yield int(n[i]), 0, raw[c.offs[i] : c.offs[i + 1]].decode()
            continue
        keep = np.flatnonzero(~gone[line_offs[i] : line_offs[i + 1]]) + line_offs[i]
        yield int(n[i]), int(lost[i]), b"\n".join(raw[starts[j] : ends[j]] for j in keep).decode()


def dedup(docs: DataFrame, width: int = LINES) -> DataFrame:
    """``docs`` with later window occurrences cut out of ``text``; rows and other columns stay."""
    order = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, at = b.column("text"), b.column("__hf_at")
            new = []
            for c in chunks(text):
                new += [t for _, _, t in _kept(c, at.slice(c.first, c.rows), width)]
            new = pa.array([t if ok else None for t, ok in zip(new, text.is_valid().to_pylist())], text.type)
            yield pa.RecordBatch.from_arrays([new if name == "text" else b.column(name) for name in order], order)

    return _joined(docs, width).mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, width: int = LINES) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by ``\\n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = b.column("text").is_valid().to_pylist()
            for c in chunks(b.column("text")):
                rows = list(_kept(c, b.column("__hf_at").slice(c.first, c.rows), width))
                lines = [n if ok[c.first + i] else 0 for i, (n, _, _) in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), pa.array(lines, pa.int64()), pa.array([r for _, r, _ in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in rows], pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    joined = _joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width)
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(texts(spark, sf_dir))


ORACLE = r"""
with d as (select doc_id, string_split(text, chr(10)) l from documents where text is not null),
w as (select doc_id, i, list_slice(l, i, i + 2) k from (select *, unnest(range(1, len(l) - 1)) i from d where len(l) >= 3)
      where regexp_matches(array_to_string(list_slice(l, i, i + 2), ''), '[^\x20\x09-\x0D]')),
f as (select *, min(doc_id) over (partition by k) least, min(i) over (partition by k, doc_id) first from w),
gone as (select distinct doc_id, unnest(range(i, i + 3)) j from f where doc_id > least or i > first),
l as (select doc_id, unnest(l) t, unnest(range(1, len(l) + 1)) j from d),
kept as (select l.doc_id, string_agg(t, chr(10) order by l.j) t from l anti join gone on l.doc_id = gone.doc_id and l.j = gone.j group by 1)
select documents.doc_id, cast(coalesce(len(d.l), 0) as bigint) n_lines, cast(coalesce((select count(*) from gone where gone.doc_id = documents.doc_id), 0) as bigint) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from documents left join d using (doc_id) left join kept using (doc_id)
"""
