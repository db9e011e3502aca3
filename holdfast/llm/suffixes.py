"""Suffix-array deduplication with deep-shallow sorting.

A byte string of ``width`` bytes that also starts in a document of a smaller id is removed. Blocks of
documents find the anchors of their windows that two documents hold (see ``anchors``) and send the bytes of
their runs, once per block and content, to the bucket of the anchor. A bucket holds shards of the suffix
array: all suffixes of a shard are ordered to ``width`` bytes by

* *shallow*: multikey quicksort, one eight-byte symbol at a time, to ``SHALLOW`` bytes;
* *deep*: groups with a longer common prefix are ordered by blind tries, kept as arrays: a group branches
  at the first symbol where its members differ, symbols in which all agree are skipped unsorted.

Neighbours with ``width`` common bytes form a class, whose smallest document is answered to the blocks; the
sort alone decides what is equal. The windows of a crowded anchor are dealt over all buckets by their content.

Defined cases: null and empty texts have no bytes; a null doc_id ranks last; rows of one doc_id don't
precede each other; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import HOT, NONE, Exchange, Symbols
from .blocks import Blocks, groups, reduce
from .textcore import chunks, covered, texts

WIDTH = 50
GRAM = 16
SHALLOW = 16
#: Text of a block that is handled at once; its arrays stay in a core's cache.
SHARD_BYTES = 1 << 16

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_U = np.uint64


def _split(order: np.ndarray, group: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order members of groups by a symbol, and number the parts anew. group: ascending."""
    rank = np.lexsort((symbol, group))
    order, group, symbol = order[rank], group[rank], symbol[rank]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])
    return order, np.cumsum(fresh) - 1


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` at ``starts`` (each with ``depth`` bytes) in the order of their first ``depth``
    bytes, as indices of ``starts``; and ascending class numbers, equal where those bytes are equal."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), ">u8", buffer=padded.data, strides=(1,))

    def symbol(which: np.ndarray, at: int) -> np.ndarray:
        value = lanes[starts[which] + at].astype(_U)
        return value if depth - at >= 8 else value >> _U(8 * (8 - (depth - at)))

    order, group = np.arange(n), np.zeros(n, np.int64)
    place = np.arange(n)  # of the open suffixes in the whole order
    whole, parts = order.copy(), np.zeros(n, np.int64)
    for at in range(0, depth, 8):
        values = symbol(order, at)
        if at < shallow:
            order, group = _split(order, group, values)
        else:
            begin, run = groups(group)
            branch = (np.minimum.reduceat(values, begin) != np.maximum.reduceat(values, begin))[run]
            if branch.any():
                some = np.flatnonzero(branch)
                part_order, part = _split(order[some], group[some], values[some])
                order = order.copy()
                order[some] = part_order
                key = np.zeros(len(order), np.int64)
                key[some] = part + 1
                group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
        whole[place] = order
        parts[place] = group
        # groups of one are done; the rest stays open
        begin, run = groups(group)
        wide = (np.diff(np.append(begin, len(group))) > 1)[run]
        # a part's number must be unique over the whole order: use its first place
        parts[place] = place[begin][run]
        if not wide.any():
            break
        order, group, place = order[wide], group[wide], place[wide]
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    return whole, parts


def _bytes(table: pa.Table) -> Iterator[Symbols]:
    d = table.column("d").to_numpy()
    for c in chunks(table.column("text"), SHARD_BYTES):
        yield Symbols(c.data, c.offs, c.data.astype(_U), d[c.first : c.first + c.rows], None, None, c.first)


def classes(data: np.ndarray, offs: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray, width: int) -> np.ndarray:
    """For the windows of a shard's segments the smallest document of their class in the suffix array."""
    segment = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(segment)) + segment * (width - 1)  # each segment is longer than its windows by so much
    order, part = deep_shallow(data, starts, width)
    low = np.full(len(order), NONE)
    if len(order):
        at, run = groups(part)
        low[order] = np.minimum.reduceat(least[segment[order]], at)[run]
    return low


def _removed(exchange: Exchange):
    def f(block, table, mail):
        ids = table.column("doc_id").combine_chunks()
        for (data, offs, _, _, _, _, row), window, length in exchange.found(table, mail):
            gone = covered(len(data), window, length + exchange.width - 1)
            total = np.concatenate([[0], np.cumsum(gone)])
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            heads = offs[:-1][np.diff(offs) > 0]
            fresh[heads] = gone[heads]
            spans = np.diff(np.concatenate([[0], np.cumsum(fresh)])[offs])
            lost = np.diff(total[offs])
            raw, digest = data.tobytes(), []
            for i in range(len(lost)):
                p, q = offs[i], offs[i + 1]
                digest.append(hashlib.sha256(data[p:q][~gone[p:q]].tobytes() if lost[i] else raw[p:q]).hexdigest())
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(lost)), pa.array(np.diff(offs)), pa.array(lost), pa.array(spans), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return f


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, **blocks: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes). blocks: sizes of
    :class:`Blocks`."""
    dealt_ = Blocks(docs, **blocks)
    exchange = Exchange(width, gram, dealt_.count, dealt_.key_bytes, hot, _bytes)
    first = reduce(dealt_.send(exchange.announce), exchange.shared)
    second = reduce(dealt_.answer(first, exchange.send), exchange.decide(partial(classes, width=width)))
    return dealt_.answer(first.unionByName(second), _removed(exchange), RESULT)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(texts(spark, sf_dir))


ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, cast(octet_length(encode(coalesce(text, ''))) as bigint) n from documents),
g as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) k from (select *, unnest(range(0, n - 49)) i from d where n >= 50)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) least from g) where doc_id > least),
starts as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) gap from gone),
spans as (select doc_id, min(i) a, max(i) + 50 b from (select *, sum(case when gap is null or gap > 50 then 1 else 0 end) over (partition by doc_id order by i) s from starts) group by doc_id, s),
kept as (select d.doc_id, sum(b - a) lost, count(*) n_spans, list(a order by a) la, list(b order by a) lb from d join spans using (doc_id) group by 1),
parts as (select d.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' order by f) r from
  (select doc_id, unnest(list_prepend(0, lb)) f, unnest(list_append(la, n)) t from kept join d using (doc_id)) x join d using (doc_id) group by 1)
select d.doc_id, n n_bytes, cast(coalesce(lost, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(r, h))) kept_sha256
from d left join kept using (doc_id) left join parts using (doc_id)
"""
