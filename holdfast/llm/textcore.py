"""Vectorised text kernels over Arrow string columns.

A batch is cut into *chunks* of whole texts of about ``CHUNK_BYTES`` (a longer text is a chunk of its
own); every kernel then works on one flat ``uint8`` buffer with text offsets, so no per-word Python
objects exist and memory follows the chunk, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
#: Rows of one Arrow batch handed to Python; with the byte bound below it keeps a worker's memory flat.
ARROW_ROWS = 1000
ARROW_BYTES = "16m"

#: Ranges up to this length are hashed without a call of their own.
LONG = 128

_U = np.uint64
_K1, _K2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def lut(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans, true for bytes within the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (on lower-cased bytes).
SPACE = lut([(0x20, 0x20), (0x09, 0x0D)])
NON_ALNUM = lut([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Chunk:
    """Rows ``first .. first + len(offs) - 2`` of a batch; bytes ``data[offs[i]:offs[i + 1]]`` are a text."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts in chunks of at most ``limit`` bytes (or one text); null reads as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Chunk(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection with full avalanche)."""
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


def split_words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the word offsets of each text. Words never cross texts."""
    word = ~sep[data]
    n = len(word)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    cuts = offs[(offs > 0) & (offs < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time for all ranges at once, up to ``LONG`` bytes;
    what is left of longer ranges is hashed range by range."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(_U) * _U(_BASE) + _U(seed))
    live, at, left = None, starts, size
    for done in range(0, LONG, 8):
        if not len(at):
            return h
        lane = lanes[at] & (~_U(0) >> ((_U(8) - np.minimum(left, 8).astype(_U)) << _U(3)))
        if live is None:
            h = mix(h ^ lane)
            live = np.flatnonzero(size > 8)
        else:
            h[live] = mix(h[live] * _U(_BASE) ^ lane)
            live = live[left > 8]
        at, left = starts[live] + done + 8, size[live] - done - 8
    if len(live):
        raw = data.tobytes()
        rest = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(at.tolist(), ends[live].tolist())]
        h[live] = mix(h[live] * _U(_BASE) ^ np.array(rest, _U))
    return h


def roll(x: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive values (len(x) - width + 1 of them), by doubling."""
    if len(x) < width:
        return np.zeros(0, _U)
    power, size, out, done = x.astype(_U), 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = power, size
            else:  # power covers the part after the done values
                n = len(x) - (done + size) + 1
                out = out[:n] * _U(pow(_BASE, size, 1 << 64)) + power[done : done + n]
                done += size
        size *= 2
        if size > width:
            return out
        power = power[: len(power) - size // 2] * _U(pow(_BASE, size // 2, 1 << 64)) + power[size // 2 :]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def spread(lengths: np.ndarray) -> np.ndarray:
    """0 .. l-1 for each length l, concatenated."""
    total = int(lengths.sum())
    out = np.arange(total)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Booleans of ``size`` positions, true within any of the ranges."""
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, size), -1)
    return np.cumsum(d[:-1]) > 0


def texts(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(text: Column) -> Column:
    """Tells rows of one id but different texts apart."""
    return F.xxhash64(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a session in one process, as in tests, may go
    without the setting and gets a private folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name the folder that executors share in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="holdfast-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path
