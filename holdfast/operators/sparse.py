"""Digests and empty pages of content.

One pass reads a content once and yields both. Binary columns go through an Arrow kernel; payloads that
stay in files are read by path in chunks with the open page carried across chunk edges, so their size is
bounded by the disk alone.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 4096
CHUNK = 1 << 20


@dataclass
class Pages:
    """Running digest and counts over the chunks of one content."""

    page: int

    def __post_init__(self) -> None:
        if self.page <= 0:
            raise ValueError("a page must hold at least one byte")
        self.digest, self.size, self.zero, self.zero_tail = hashlib.sha1(), 0, 0, 0
        self.filled, self.clean = 0, True  # of the open page

    def add(self, chunk: bytes) -> None:
        self.digest.update(chunk)
        self.size += len(chunk)
        data = np.frombuffer(chunk, np.uint8)
        head = min(len(data), (self.page - self.filled) % self.page)
        if head:
            self.clean &= not data[:head].any()
            self.filled += head
            if self.filled == self.page:
                self.zero += self.clean
                self.filled, self.clean = 0, True
            data = data[head:]
        whole = len(data) // self.page
        if whole:
            self.zero += int((~data[: whole * self.page].reshape(whole, self.page).any(axis=1)).sum())
        if len(data) > whole * self.page:
            self.filled, self.clean = len(data) - whole * self.page, not data[whole * self.page :].any()

    def result(self) -> tuple[str, int, int, int]:
        """sha1, size, full zero pages, bytes that a sparse copy leaves out (a zero tail counts here only)."""
        return self.digest.hexdigest(), self.size, self.zero, self.zero * self.page + (self.filled if self.filled and self.clean else 0)


def inspect(chunks: Iterable[bytes], page: int = PAGE) -> tuple[str, int, int, int]:
    pages = Pages(page)
    for c in chunks:
        pages.add(c)
    return pages.result()


def read_chunks(path: str, size: int = CHUNK) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while chunk := f.read(size):
            yield chunk


INSPECTED = "id long, sha1 string, size long, sparse_count long, bytes_saved long, error string"


def inspect_content(df: DataFrame, page: int = PAGE) -> DataFrame:
    """``df(id, content binary)`` -> INSPECTED. A null content has null figures."""
    Pages(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None,) * 4 if c is None else inspect([c], page) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_pylist([{"id": i, "sha1": r[0], "size": r[1], "sparse_count": r[2], "bytes_saved": r[3], "error": None} for i, r in zip(b.column("id").to_pylist(), rows)], _SCHEMA)

    return df.select(F.col("id").cast("long"), F.col("content").cast("binary")).mapInArrow(run, INSPECTED)


def inspect_paths(df: DataFrame, page: int = PAGE) -> DataFrame:
    """``df(id, path)`` of files that every executor can read -> INSPECTED; what fails says why."""
    Pages(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, path in zip(b.column("id").to_pylist(), b.column("path").to_pylist()):
                row = dict.fromkeys(_SCHEMA.names) | {"id": i}
                try:
                    row |= dict(zip(("sha1", "size", "sparse_count", "bytes_saved"), inspect(read_chunks(path), page)))
                except OSError as e:
                    row["error"] = str(e)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return df.select(F.col("id").cast("long"), F.col("path").cast("string")).mapInArrow(run, INSPECTED)


_SCHEMA = pa.schema([("id", pa.int64()), ("sha1", pa.string()), ("size", pa.int64()), ("sparse_count", pa.int64()), ("bytes_saved", pa.int64()), ("error", pa.string())])


def zero_pages(content: Column, page: int) -> Column:
    """Full pages of zero bytes, with DataFrame functions only (for small contents)."""
    whole = F.floor(F.octet_length(content) / page).cast("int")
    empty = F.lit(bytes(page)).cast("binary")
    places = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(content.isNotNull(), F.size(F.filter(places, lambda i: F.substring(content, i * page + 1, F.lit(page)) == empty)).cast("long"))


@dataclass
class CopyStats:
    size_in: int
    size_out: int
    bytes_saved: int
    zero_blocks: int


def sparse_copy(source: str, target: str, page: int = PAGE) -> CopyStats:
    """Copy a file with holes for its zero pages. A short zero tail is left out too, but is no page."""
    if page <= 0:
        raise ValueError("a page must hold at least one byte")
    saved = zero = 0
    with open(source, "rb") as src, open(target, "wb") as dst:
        while block := src.read(page):
            if block.count(0) == len(block):
                dst.seek(len(block), os.SEEK_CUR)
                saved += len(block)
                zero += len(block) == page
            else:
                dst.write(block)
        size = src.tell()
        dst.truncate(size)
        dst.flush()
        os.fsync(dst.fileno())
    shutil.copystat(source, target)
    return CopyStats(size, os.stat(target).st_blocks * 512, saved, zero)


def sparse_copies(df: DataFrame, page: int = PAGE) -> DataFrame:
    """``df(id, source, target)`` on a file system that every executor shares -> (id, ok, size_in,
    size_out, bytes_saved, zero_blocks, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, s, t in zip(*(b.column(c).to_pylist() for c in ("id", "source", "target"))):
                row = dict.fromkeys(_COPIES.names) | {"id": i, "ok": True}
                try:
                    row |= vars(sparse_copy(s, t, page))
                except OSError as e:
                    row |= {"ok": False, "error": str(e)}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _COPIES)

    return df.select(F.col("id").cast("long"), "source", "target").mapInArrow(run, "id long, ok boolean, size_in long, size_out long, bytes_saved long, zero_blocks long, error string")


_COPIES = pa.schema([("id", pa.int64()), ("ok", pa.bool_()), ("size_in", pa.int64()), ("size_out", pa.int64()), ("bytes_saved", pa.int64()), ("zero_blocks", pa.int64()), ("error", pa.string())])


def make_file(path: str, size: int, page: int = PAGE, dirty: int = 1, seed: int = 0) -> None:
    """A file of ``size`` bytes of which ``dirty`` whole pages, drawn by the seed, hold non-zero bytes."""
    pages = size // page
    if not 0 <= dirty <= pages:
        raise ValueError(f"{dirty} dirty pages of {pages}")
    rng = np.random.default_rng(seed)
    with open(path, "wb") as f:
        f.truncate(size)
        for k in sorted(rng.choice(pages, dirty, replace=False).tolist()) if dirty else []:
            f.seek(k * page)
            f.write(rng.integers(1, 256, page, dtype=np.uint8).tobytes())
