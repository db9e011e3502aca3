"""Blocks of documents that exchange packed arrays.

Searches for repeated windows need one small fact per window from every document and an answer back. As
single rows they would cost several times the text, so documents are dealt into even *blocks* by a hash of
id and text, and a block sends each *bucket* (a range of hash values) one packed message. Buckets are
reduced in one task each: a block has summed its own entries first, so a key sends one entry per block at
most, however many documents hold it. Answers are messages to blocks.

A block exchanges messages with every bucket, so n blocks send up to n x n messages a round. n is the root of
the text's size over ``MESSAGE_BYTES``: there is one message for so many bytes of text, at every size until
blocks reach ``BLOCK_BYTES`` (2 TB of text). Beyond that blocks keep their size, since a task holds one, and
messages carry fewer entries each; there are never more messages than entries, which are in proportion to the
text, so the exchange stays linear, with a row's overhead for each entry at worst.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 128 << 20
MESSAGE_BYTES = 8 << 10
LEAST = 16
LAST = (1 << 63) - 1

MESSAGE = "kind int, target long, origin long, payload binary"
_NAMES = ["kind", "target", "origin", "payload"]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, equal bytes of neighbouring values side by side (they compress)."""
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)])


def short(key: np.ndarray, size: int) -> np.ndarray:
    """The lower ``size`` bytes of 64-bit values, as rows of bytes."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def unpacked(payload: bytes, kinds: list) -> list[np.ndarray]:
    """Arrays of the given kinds; a number n stands for 64-bit values of which n bytes were packed."""
    n, at, out = int(np.frombuffer(payload, np.int64, 1)[0]), 8, []
    for kind in kinds:
        if isinstance(kind, int):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :kind] = np.frombuffer(payload, np.uint8, n * kind, at).reshape(kind, n).T
            out.append(wide.reshape(-1).view("<u8"))
            at += n * kind
            continue
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n).T.copy().reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * size
    return out


def gathered(payloads: list[bytes], kinds: list) -> list[np.ndarray]:
    """The messages' arrays joined, and which message each entry is from (last)."""
    parts = [unpacked(p, kinds) for p in payloads]
    if not parts:
        return [np.zeros(0, np.uint64 if isinstance(k, int) else k) for k in kinds] + [np.zeros(0, np.int64)]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))] + [np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])]


def messages(kind: int, targets: np.ndarray, origin: int, payloads: list[bytes]) -> pa.RecordBatch:
    n = len(payloads)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(targets, np.int64)), pa.array(np.full(n, origin, np.int64)), pa.array(payloads, pa.binary())], _NAMES)


def dealt(kind: int, origin: int, target: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """One message per distinct target with its entries of the arrays, in their order."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    arrays = tuple(a[order] for a in arrays)
    cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(target))
    return messages(kind, target[cut], origin, [packed(*(a[i:j] for a in arrays)) for i, j in zip(cut, ends)])


def steps(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Differences of ascending values, from zero anew in every run of a group; small numbers compress."""
    out = np.diff(value, prepend=value[:1] * 0)
    begin, _ = groups(group)
    out[begin] = value[begin]
    return out


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in an ordered key, and each entry's run."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def number(size: int, block_bytes: int = BLOCK_BYTES, message_bytes: int = MESSAGE_BYTES, least: int = LEAST) -> int:
    """How many blocks, and buckets, a text of so many bytes is dealt into."""
    return max(least, -(-size // block_bytes), math.isqrt(size // message_bytes))


class Blocks:
    """``docs(doc_id, text)`` in blocks. d: doc_id with null as the last; null text reads as empty."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, message_bytes: int = MESSAGE_BYTES, least: int = LEAST):
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        #: Enough of a hash to tell anchors of this much text apart.
        self.key_bytes = min(8, -(-(int(size).bit_length() + 6) // 8))
        self.count = number(size, block_bytes, message_bytes, least)
        self.docs = narrow.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("block", F.pmod(F.xxhash64("d", "text"), F.lit(self.count)))
        self.schema = "doc_id long, text string, d long, block long"

    def send(self, f) -> DataFrame:
        """Messages of each block: f(block, table) -> message batches."""

        def run(table: pa.Table) -> pa.Table:
            return _table(f(table.column("block")[0].as_py(), table))

        return self.docs.groupBy("block").applyInArrow(run, MESSAGE)

    def answer(self, inbox: DataFrame, f, schema: str = MESSAGE) -> DataFrame:
        """f(block, table, inbox rows as (kind, origin, payload)) -> batches, for every block."""

        def run(table: pa.Table, inbox: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _table([], schema)
            mail = list(zip(*(inbox.column(x).to_pylist() for x in ("kind", "origin", "payload"))))
            return _table(f(table.column("block")[0].as_py(), table, mail), schema)

        return self.docs.groupBy("block").cogroup(inbox.groupBy("target")).applyInArrow(run, schema)


def reduce(mail: DataFrame, f) -> DataFrame:
    """Messages of each bucket: f(bucket, origins, payloads) -> message batches."""

    def run(table: pa.Table) -> pa.Table:
        return _table(f(table.column("target")[0].as_py(), table.column("origin").to_numpy(), table.column("payload").to_pylist()))

    return mail.groupBy("target").applyInArrow(run, MESSAGE)


def _table(batches, schema: str = MESSAGE) -> pa.Table:
    batches = list(batches)
    if batches:
        return pa.Table.from_batches(batches)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(",")]
    return pa.table({n: pa.array([], kinds[k]) for n, k in fields})
