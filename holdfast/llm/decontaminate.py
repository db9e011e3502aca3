"""Benchmark decontamination by training suffix arrays.

Every block of whole documents is a shard with a word suffix array (prefix doubling to at least the
window's depth). Each benchmark suffix is binary-searched in it, one word deeper per step, for all
suffixes at once; those that keep an interval down to the window's depth give every place where the
window occurs, and comparing onward from there gives the longest verbatim match.

A document's hits depend on that document and the benchmark alone, so the documents never move. The
benchmark is the query side: it goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text. Passes over
the blocks follow each other, and each carries the row's hits so far along with the row, so rows are never
joined back; after every ``ALIVE`` passes the rows are written to the shared folder and the blocks' broadcasts
dropped, so what a task holds does not grow with the benchmark.

Defined cases: null or empty text has no words; a null item has none either and never matches; rows of
one doc_id, and repeated rows, are reported row by row, whatever the number of blocks; an item_id that
repeats is one item with all its rows' windows; items without item_id are one item without a name, whose
windows count as any other's; an item of fewer than ``width`` words is one window; an empty benchmark
contaminates nothing; further columns are ignored, or kept by :func:`remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import LOWER, NON_ALNUM, chunks, covered, hash_words, shared_dir, spread, split_words, texts

WIDTH = 10
BLOCK_BYTES = 32 << 20
#: A block's broadcast holds its word hashes (8 bytes a word of two bytes at least), so under 5 x BLOCK_BYTES.
ALIVE = 4
#: Columns that a pass adds: what is known of the row's hits.
FOUND = T.StructType([T.StructField("__hf_words", T.LongType()), T.StructField("__hf_begins", T.ArrayType(T.LongType())), T.StructField("__hf_lengths", T.ArrayType(T.LongType())), T.StructField("__hf_items", T.ArrayType(T.StringType()))])
MATCHES = "doc_id long, item_id string, item_word int, doc_word int, n_words int"


def words_of(column: pa.Array):
    """Chunks with lower-cased bytes, their word hashes and word offsets."""
    for c in chunks(column):
        data = LOWER[c.data]
        starts, ends, offs = split_words(data, c.offs, NON_ALNUM)
        yield c, hash_words(data, starts, ends), offs


class Suffixes:
    """The benchmark's suffixes: word hashes, and for each suffix its place, window depth and item."""

    def __init__(self, ids: list[str | None], column: pa.Array, width: int):
        self.ids = ids
        parts, at, depth, item = [], [], [], []
        base = 0
        for c, h, offs in words_of(column):
            parts.append(h)
            n = np.diff(offs)
            count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
            item.append(np.repeat(np.arange(c.rows) + c.first, count))
            at.append(np.repeat(offs[:-1], count) + spread(count) + base)
            depth.append(np.repeat(np.minimum(n, width), count))
            base += len(h)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.words, self.at, self.depth, self.item = join(parts, np.uint64), join(at, np.int64), join(depth, np.int64), join(item, np.int64)
        end = np.zeros(len(ids) + 1, np.int64)
        np.maximum.at(end, self.item, self.at + self.depth)
        self.end = end[self.item] if len(self.item) else self.item


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of x ordered by at least their first ``depth`` values (values compare as numbers)."""
    _, rank = np.unique(x, return_inverse=True)
    rank, size, n = rank.astype(np.int64), 1, len(x)
    order = np.argsort(rank, kind="stable")
    while size < depth:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key)
        step = np.empty(n, np.int64)
        step[0] = 0
        ordered = key[order]
        step[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = step
        size *= 2
        if step[-1] == n - 1:
            break
    return order


def search(x: np.ndarray, sa: np.ndarray, q: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of q whose window occurs in x, with their intervals [lo, hi) of the suffix array."""
    live = np.arange(len(q.at))
    first = x[sa]
    lo, hi = np.searchsorted(first, q.words[q.at], "left"), np.searchsorted(first, q.words[q.at], "right")
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, j = len(x), 1
    while True:
        keep = hi > lo
        live, lo, hi = live[keep], lo[keep], hi[keep]
        full = q.depth[live] <= j
        done.append((live[full], lo[full], hi[full]))
        live, lo, hi = live[~full], lo[~full], hi[~full]
        if not len(live):
            return tuple(np.concatenate(p) for p in zip(*done))
        want = q.words[q.at[live] + j]
        bounds = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                at = sa[np.minimum(mid, n - 1)] + j
                value, inside = x[np.minimum(at, n - 1)], at < n
                less = ~inside | ((value <= want) if right else (value < want))
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        lo, hi = bounds
        j += 1


def shard(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk with a value of its own after every text; the text and the word number of each place."""
    n = np.diff(offs)
    rows = len(n)
    text = np.repeat(np.arange(rows), n + 1)
    word = spread(n + 1)
    x = np.empty(len(h) + rows, np.uint64)
    end = np.cumsum(n + 1) - 1
    inside = np.ones(len(x), bool)
    inside[end] = False
    x[inside] = h
    x[end] = np.arange(rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2D)
    return x, text, word


def occurrences(h: np.ndarray, offs: np.ndarray, q: Suffixes):
    """(suffix of q, text, first word) of every window that occurs in a chunk; the chunk's shard."""
    x, text, word = shard(h, offs)
    if not len(h) or not len(q.at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, x
    sa = suffix_array(x, int(q.depth.max()))
    suffix, lo, hi = search(x, sa, q)
    place = sa[np.repeat(lo, hi - lo) + spread(hi - lo)]
    return np.repeat(suffix, hi - lo), text[place], place, x


def _named(ids: set) -> list:
    return sorted(ids, key=lambda x: (x is None, x))


def _hits(q, first: bool):
    """Rows with their hits of a block of the benchmark, united with those they bring from the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = None if first else [b.column(f.name).to_pylist() for f in FOUND.fields[1:]]
            bare = b if first else b.select(b.schema.names[: -len(FOUND.fields)])
            for c, h, offs in words_of(b.column("text")):
                suffix, text, place, _ = occurrences(h, offs, q.value)
                word = place - offs[text] - text
                order = np.lexsort((word, text))
                suffix, text, word = suffix[order], text[order], word[order]
                cut = np.searchsorted(text, np.arange(c.rows + 1))
                out: list[list] = [[], [], []]
                for i in range(c.rows):
                    part = slice(cut[i], cut[i + 1])
                    begin, length, ids = word[part], q.value.depth[suffix[part]], {q.value.ids[k] for k in np.unique(q.value.item[suffix[part]])}
                    if before:
                        old = [x[c.first + i] for x in before]
                        begin, length, ids = np.append(begin, old[0]).astype(np.int64), np.append(length, old[1]).astype(np.int64), ids | set(old[2])
                    if len(begin):
                        hit = np.flatnonzero(np.diff(covered(int(offs[i + 1] - offs[i]), begin, length).astype(np.int8), prepend=0, append=0))
                        begin, length = hit[::2], hit[1::2] - hit[::2]
                    for x, v in zip(out, (begin, length, _named(ids))):
                        x.append(v)
                arrays = [pa.array(np.diff(offs)), *(pa.array(x, pa.list_(pa.int64())) for x in out[:2]), pa.array(out[2], pa.list_(pa.string()))]
                own = bare.slice(c.first, c.rows)
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, *FOUND.names])

    return run


def _matches(q):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, h, offs in words_of(b.column("text")):
                s, text, place, x = occurrences(h, offs, q.value)
                at, length = q.value.at[s], q.value.depth[s].copy()
                # a match that the word before extends is not the longest one
                begin = np.concatenate([[True], q.value.item[1:] != q.value.item[:-1]])[s] if len(s) else np.zeros(0, bool)
                inner = ~begin & (place > 0) & (x[np.maximum(place - 1, 0)] == q.value.words[np.maximum(at - 1, 0)])
                s, text, place, at, length = s[~inner], text[~inner], place[~inner], at[~inner], length[~inner]
                grow, end = np.arange(len(s)), q.value.end[s]
                while len(grow):
                    p, r = place[grow] + length[grow], at[grow] + length[grow]
                    ok = (r < end[grow]) & (p < len(x))
                    ok &= x[np.minimum(p, len(x) - 1)] == q.value.words[np.minimum(r, len(q.value.words) - 1)]
                    grow = grow[ok]
                    length[grow] += 1
                item = q.value.item[s]
                first = np.searchsorted(q.value.item, item)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows).take(pa.array(text)), pa.array([q.value.ids[k] for k in item], pa.string()), pa.array((at - q.value.at[first]).astype(np.int32)), pa.array((place - offs[text] - text).astype(np.int32)), pa.array(length.astype(np.int32))], ["doc_id", "item_id", "item_word", "doc_word", "n_words"])

    return run


def _blocks(benchmark: DataFrame, width: int):
    """Broadcasts of the benchmark's suffixes, block by block of bounded size; one at least."""
    spark = benchmark.sparkSession
    send = lambda rows: spark.sparkContext.broadcast(Suffixes([x.i for x in rows], pa.array([x.t for x in rows], pa.string()), width))
    rows, size, sent = [], 0, 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        rows.append(r)
        size += len((r.t or "").encode())
        if size >= BLOCK_BYTES:
            yield send(rows)
            rows, size, sent = [], 0, sent + 1
    if rows or not sent:
        yield send(rows)


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Longest verbatim matches (no word before or after extends them) of ``width`` words or a whole
    shorter item: doc_id, item_id, item_word and doc_word (from 0), n_words."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for q in _blocks(benchmark, width):
        part = narrow.mapInArrow(_matches(q), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def _found(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """``docs`` with the columns ``FOUND``; every pass takes whole rows and returns them."""
    schema = T.StructType([*docs.schema.fields, *FOUND.fields])
    alive, first = [], True
    for q in _blocks(benchmark, width):
        if len(alive) == ALIVE:
            shared_dir(docs.sparkSession)
            docs = docs.checkpoint()
            for x in alive:
                x.unpersist()
            alive = []
        docs, first = docs.mapInArrow(_hits(q, first), schema), False
        alive.append(q)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document row: doc_id, n_words, hit word ranges (begins, lengths) and the items found."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _found(narrow, benchmark, width).select("doc_id", *(F.col(n).alias(n[5:] if n != "__hf_words" else "n_words") for n in FOUND.names))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_share: float = 0.0) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; every column is kept.

    least_share: hit words over words above which a document goes; 0 means any hit."""
    n_hit = F.expr("aggregate(__hf_lengths, 0L, (a, x) -> a + x)")
    return _found(docs, benchmark, width).where(~((n_hit > 0) & (n_hit >= F.lit(least_share) * F.col("__hf_words")))).select(docs.columns)


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from :func:`contamination`."""
    return hits.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("lengths") > 0).alias("contaminated"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(texts(spark, sf_dir), texts(spark, sf_dir, "benchmark")))


ORACLE = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from documents),
bw as (select cast(item_id as varchar) item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from benchmark),
bg as (select distinct item, least(len(w), 10) k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') g from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from bw where len(w) > 0)),
dg as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, (select distinct k from bg) where len(w) >= k)),
m as (select doc_id, i, dg.k, item from dg join bg on dg.g = bg.g and dg.k = bg.k),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from m)) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from m) group by 1)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hits using (doc_id) left join items using (doc_id)
"""
