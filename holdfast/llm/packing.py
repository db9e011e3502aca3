"""Best-fit packing with several capacities (vector best-fit).

Every document becomes token ids and an end id; what is longer than a sequence is cut into full pieces,
the remainder first. A bin has three capacities: tokens, documents, and attention cost (the sum of squared
lengths). Pieces go in decreasing length to the open bin that can take them under every capacity and whose
weighted residual norm after that is least (``rule="norm"``), or whose weighted dot-product of demand and
residual is greatest (``rule="dot"``).

Pieces are dealt by a hash into partitions of about ``GROUP``, at most ``PARTITIONS`` of them, and a
partition is packed in groups of one to two ``GROUP``, so a task's memory is bounded whatever the corpus;
that costs about one half-filled sequence a group.
Full pieces fill a sequence and are never searched for.

Defined cases: null and empty texts are the end id alone; strings of special tokens are ordinary text;
repeated rows are packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import shared_dir, texts

TOKENS = 1024
END = 2
GROUP = 10_000
PARTITIONS = 50_000
#: Capacities of a sequence besides its tokens; these two follow from 1024 tokens and so never refuse a piece.
DOCUMENTS = TOKENS
ATTENTION = TOKENS * TOKENS
WEIGHTS = (1.0, 1e-3, 1e-3)
#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary as ranks and as a tokenizer file (the same ids)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a text. The ranks' encoder is the fast way to the tokenizer file's ids; a text that it
    refuses goes to the tokenizer itself."""

    def __init__(self, ranks: str, tokenizer: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.file, self.slow = tokenizer, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")
        except BaseException as e:
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first one that may be shorter."""
    first = n % most
    return ([(0, first)] if first else []) + [(k, most) for k in range(first, n, most)]


def pieces(docs: DataFrame, most: int = TOKENS, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    paths = paths or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or Encoder(*paths)
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), most)):
                    for column, value in zip(rows, (i, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights: tuple = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths above a capacity alone are refused."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and (lengths.max() > tokens or int(lengths.max()) ** 2 > attention or documents < 1):
        raise ValueError("a piece is beyond a sequence's capacities")
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if n else 0
    left = np.empty((3, max(n, 1)))
    cap, w = np.array([tokens, documents, attention], float), np.array(weights, float)
    ids = np.empty(max(n, 1), np.int64)
    live = bins = closed = 0
    for i in order:
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)
        if size < tokens and live:
            r = left[:, :live]
            ok = (r[0] >= size) & (r[1] >= 1) & (r[2] >= need[2])
            if rule == "norm":
                cost = w[0] * ((r[0] - size) / cap[0]) ** 2 + w[1] * ((r[1] - 1) / cap[1]) ** 2 + w[2] * ((r[2] - need[2]) / cap[2]) ** 2
            else:
                cost = -(w * need / cap**2) @ r
            cost[~ok] = np.inf
            k = int(cost.argmin())
            if ok[k]:
                where[i], offset[i] = ids[k], int(tokens - left[0, k])
                left[:, k] -= need
                if left[0, k] < smallest or left[1, k] < 1 or left[2, k] < smallest * smallest:
                    live -= 1
                    left[:, k], ids[k] = left[:, live], ids[live]
                continue
        where[i] = bins
        rest = cap - need
        if rest[0] >= smallest and rest[1] >= 1 and rest[2] >= smallest * smallest:
            left[:, live], ids[live] = rest, bins
            live += 1
        bins += 1
    return where, offset


def pack(parts: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights: tuple = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """``parts`` (as from :func:`pieces`) with sequence_id and offset."""
    shared_dir(parts.sparkSession)
    parts = parts.checkpoint()  # the ids are made once; the number of groups follows the count
    partitions = min(PARTITIONS, max(1, -(-parts.count() // group)))

    def packed(got: list[pa.RecordBatch], base: int) -> tuple[pa.Table, int]:
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        where, offset = best_fit(t.column("length").to_numpy(), tokens, documents, attention, weights, rule)
        return t.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset)), base + int(where.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, base = [], TaskContext.get().partitionId() << 32
        for b in batches:
            got.append(b)
            if sum(x.num_rows for x in got) >= 2 * group:
                t, base = packed(got, base)
                got = []
                yield from t.to_batches(max_chunksize=10_000)
        if sum(x.num_rows for x in got):
            yield from packed(got, base)[0].to_batches(max_chunksize=10_000)

    return parts.repartition(partitions, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(texts(spark, sf_dir)))
