"""Sampling of windows by their least n-gram, and the exchange that brings equal windows together.

The *anchor* of a window of ``width`` symbols is the least hash of its ``gram``-symbol n-grams. Equal
windows have equal anchors, and consecutive windows with one anchor form a *run*. So two documents can
share a window only where they share an anchor:

1. blocks announce their distinct anchors to buckets, which answer the anchors that two documents hold;
2. blocks send the text of the runs of those anchors, a *segment* each and once per content, to the bucket
   that the anchor names, with the smallest and the largest document that hold it;
3. a bucket decides by the segments' text (the caller's method), shard by shard, which windows a smaller
   document has, and answers the stretches of them to the blocks.

Hashes only choose what meets where; equality is decided in step 3. An anchor of more than ``HOT`` runs (a
string in a great share of all documents, with ever new contexts) would fill one shard: its windows travel as
segments of their own, each to the bucket that its whole content names, and are decided there all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from .blocks import dealt, gathered, groups, messages, packed, short, steps, unpacked
from .textcore import mix, roll, sliding_min, spread

_U = np.uint64
#: Kinds of answers: anchors that two documents hold; such ones of more than ``HOT`` runs; stretches of windows.
SHARED, CROWDED, SPAN = 0, 1, 2
HOT = 4096
NONE = np.iinfo(np.int64).max
#: Windows of a shard, at least one anchor's; arrays of this length stay in a core's cache.
SHARD = 1 << 16


def runs(x: np.ndarray, offs: np.ndarray, width: int, gram: int):
    """Runs of the texts ``x[offs[i]:offs[i + 1]]``: (text, first window, windows, anchor, content hash),
    where first windows count within x, and the hashes of all windows."""
    none = np.zeros(0, np.int64)
    if len(x) < width:
        return none, none, none, none.view(_U), none.view(_U), none.view(_U)
    window = mix(roll(x, width))
    least = sliding_min(mix(roll(x, gram) + _U(gram)), width - gram + 1)
    n = np.diff(offs)
    ok = np.zeros(len(window) + 1, np.int32)
    some = np.flatnonzero(n >= width)
    ok[offs[some]] += 1
    ok[offs[some] + n[some] - width + 1] -= 1
    ok = np.cumsum(ok[:-1]) > 0
    fresh = np.ones(len(window), bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(fresh)
    size = np.diff(np.append(starts, len(window)))
    each = mix(window + spread(size).astype(_U) * _U(0x9E3779B97F4A7C15))
    each[~ok] = 0  # windows across texts are no content
    content = np.add.reduceat(each, starts)
    keep = ok[starts]
    starts, content = starts[keep], content[keep]
    # a kept run ends where the next one begins or where validity ends
    last = np.concatenate([[0], np.cumsum(ok)])
    size = size[keep]
    size = last[starts + size] - last[starts]
    return np.searchsorted(offs, starts, "right") - 1, starts, size, least[starts], content, window


def summed(key: np.ndarray, d: np.ndarray):
    """Per distinct key: least and most d, number of entries."""
    order = np.argsort(key, kind="stable")
    key, d = key[order], d[order]
    at, _ = groups(key)
    if not len(key):
        return key, d, d, d
    return key[at], np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), np.diff(np.append(at, len(key)))


def quotient(size: int, buckets: int) -> int:
    """Bytes of a key of ``size`` bytes divided by the number of buckets."""
    return max(1, -(-(8 * size - (buckets.bit_length() - 1)) // 8))


def member(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted values are among the ordered keys."""
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


class Symbols(NamedTuple):
    """A chunk of a block: its bytes, the texts' offsets in symbols, the symbols' hashes, the texts' documents,
    first and end byte of every symbol (None where symbols are bytes), and the chunk's first row."""

    data: np.ndarray
    offs: np.ndarray
    x: np.ndarray
    doc: np.ndarray
    begin: np.ndarray | None
    end: np.ndarray | None
    row: int


@dataclass
class Exchange:
    """Windows of ``width`` symbols. read(table) gives the chunks of a block.

    size: bytes of an anchor's hash that tell anchors of this much text apart. A short key can only join
    different anchors; that costs work, not truth."""

    width: int
    gram: int
    buckets: int
    size: int
    hot: int
    read: Callable[[pa.Table], Iterator[Symbols]]

    def announce(self, block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The first message of a block: its distinct anchors, as the upper ``size`` bytes of their hashes."""
        a, d = [], []
        for c in self.read(table):
            text, _, _, anchor, _, _ = runs(c.x, c.offs, self.width, self.gram)
            a.append(anchor >> _U(64 - 8 * self.size)), d.append(c.doc[text])
        if a:
            key, least, most, n = summed(np.concatenate(a), np.concatenate(d))
            target = (key % _U(self.buckets)).astype(np.int64)
            # a bucket knows its remainder, and ordered documents differ by little: fewer bytes move
            order = np.lexsort((least, target))
            target, least = target[order], least[order]
            yield dealt(0, block, target, short((key // _U(self.buckets))[order], quotient(self.size, self.buckets)), steps(target, least), most[order] - least, n[order].astype(np.int32))

    def shared(self, bucket: int, origins: np.ndarray, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Answers to blocks: those of their anchors that two documents hold."""
        key, step, span, n, origin = gathered(payloads, [quotient(self.size, self.buckets), np.int64, np.int64, np.int32])
        if not len(key):
            return
        begin, run = groups(origin)
        total = np.cumsum(step)
        least = total - (total - step)[begin][run]
        order = np.argsort(key, kind="stable")
        key, least, most, n, origin = (v[order] for v in (key, least, least + span, n, origins[origin]))
        at, run = groups(key)
        both = np.minimum.reduceat(least, at) < np.maximum.reduceat(most, at)
        many = np.add.reduceat(n.astype(np.int64), at) > self.hot
        for kind, pick in ((SHARED, (both & ~many)[run]), (CROWDED, (both & many)[run])):
            if pick.any():
                order = np.argsort(origin[pick], kind="stable")
                target, value = origin[pick][order], key[pick][order]
                yield dealt(kind, bucket, target, steps(target, value))

    def _inbox(self, mail, kind: int) -> np.ndarray:
        parts = [np.cumsum(unpacked(p, [_U])[0], dtype=_U) * _U(self.buckets) + _U(origin) for k, origin, p in mail if k == kind]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, _U)

    def _segments(self, table: pa.Table, mail):
        """Per chunk what is to be sent: (chunk, text, first window, windows, route, name). Equal names are equal
        segments; a name begins as its route does."""
        shared, crowded = self._inbox(mail, SHARED), self._inbox(mail, CROWDED)
        for c in self.read(table):
            text, first, n, anchor, content, window = runs(c.x, c.offs, self.width, self.gram)
            key = anchor >> _U(64 - 8 * self.size)
            a, b = member(shared, key), member(crowded, key)
            each = np.repeat(first[b], n[b]) + spread(n[b])
            route = np.concatenate([mix(anchor[a] + _U(0x5851F42D4C957F2D)), mix(window[each] + _U(0x14057B7EF767814F))])
            content = np.concatenate([content[a], window[each]])
            name = (route & ~_U((1 << 48) - 1)) | (mix(route ^ mix(content)) >> _U(16))
            yield c, np.concatenate([text[a], np.repeat(text[b], n[b])]), np.concatenate([first[a], each]), np.concatenate([n[a], np.ones(len(each), np.int64)]), route, name

    def _numbered(self, route: np.ndarray, name: np.ndarray):
        """Distinct segments in the order of target and name: target, one entry of each; each entry's number."""
        target = (route % _U(self.buckets)).astype(np.int64)
        order = np.lexsort((name, target))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (target[order][1:] != target[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return target[order][fresh], order, np.flatnonzero(fresh), number

    def send(self, block: int, table: pa.Table, mail) -> Iterator[pa.RecordBatch]:
        """The second message: the segments, ordered by name, with their least and most documents and text."""
        parts, base = [], 0
        for c, text, first, n, route, name in self._segments(table, mail):
            begin, end = (first, first + n + self.width - 1) if c.begin is None else (c.begin[first], c.end[first + n + self.width - 2])
            parts.append((c.data, c.doc[text], n, route, name, begin + base, end - begin))
            base += len(c.data)
        if not parts or not any(len(p[1]) for p in parts):
            return
        data, (d, n, route, name, begin, size) = np.concatenate([p[0] for p in parts]), (np.concatenate([p[i] for p in parts]) for i in range(1, 7))
        target, order, fresh, _ = self._numbered(route, name)
        least, most = np.minimum.reduceat(d[order], fresh), np.maximum.reduceat(d[order], fresh)
        one = order[fresh]
        n, begin, size, sub = n[one].astype(np.int32), begin[one], size[one], (name[one] >> _U(48)).astype(np.int64)
        sub = steps(target, sub).astype(np.uint16)
        cut, _ = groups(target)
        ends = np.append(cut[1:], len(target))
        press, out = zstandard.ZstdCompressor(level=1), []
        for i, j in zip(cut.tolist(), ends.tolist()):
            at = np.repeat(begin[i:j], size[i:j]) + spread(size[i:j])
            out.append(press.compress(packed(sub[i:j], n[i:j], size[i:j].astype(np.int32), least[i:j], (most - least)[i:j]) + data[at].tobytes()))
        yield messages(0, target[cut], block, out)

    def decide(self, method):
        """The answers of a bucket. method(bytes, offsets, windows, least, most) gives for all windows of the
        segments, in their order, the smallest document with it, or ``NONE``."""
        kinds = [np.uint16, np.int32, np.int32, np.int64, np.int64]

        def f(bucket, origins, payloads):
            unpress, parts, texts = zstandard.ZstdDecompressor(), [], []
            for p in payloads:
                p = unpress.decompress(p)
                sub, n, size, least, span = unpacked(p, kinds)
                parts.append((np.cumsum(sub, dtype=np.int64), n.astype(np.int64), size.astype(np.int64), least, least + span, np.arange(len(n))))
                texts.append(np.frombuffer(p, np.uint8)[8 + 26 * len(n) :])
            data = np.concatenate(texts)
            sub, n, size, least, most, number = (np.concatenate([p[i] for p in parts]) for i in range(6))
            origin = np.repeat(origins, [len(p[0]) for p in parts])
            begin = np.cumsum(size) - size
            order = np.argsort(sub, kind="stable")
            # shards end where a part of the anchors' hashes ends
            total, edge = np.cumsum(n[order]), np.flatnonzero(np.append(np.diff(sub[order]), 1)) + 1
            found, at = [], 0
            while at < len(order):
                done = total[at - 1] if at else 0
                over = int(np.searchsorted(total, done + SHARD, "right"))
                k = int(np.searchsorted(edge, over, "right")) - 1
                to = int(edge[k]) if k >= 0 and edge[k] > at else int(edge[np.searchsorted(edge, at, "right")])
                s = order[at:to]
                at = to
                text = data[np.repeat(begin[s], size[s]) + spread(size[s])]
                low = method(text, np.concatenate([[0], np.cumsum(size[s])]), n[s], least[s], most[s])
                found.append(stretches(s, n[s], most[s], low))
            s, window, length, low = (np.concatenate([x[i] for x in found]) for i in range(4))
            order = np.lexsort((window, number[s], origin[s]))
            s, window, length, low = s[order], window[order], length[order], low[order]
            if len(s):
                yield dealt(SPAN, bucket, origin[s], steps(origin[s], number[s]).astype(np.int32), window.astype(np.int32), length.astype(np.int32), low)

        return f

    def found(self, table: pa.Table, mail) -> Iterator[tuple]:
        """Per chunk of a block: (chunk, first window, windows) of the stretches that a smaller document has."""
        parts = list(self._segments(table, mail))
        route, name = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, _U) for i in (4, 5))
        target, _, _, number = self._numbered(route, name)
        which, window, length, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k, origin, p in mail:
            if k == SPAN:
                step, w, m, v = unpacked(p, [np.int32, np.int32, np.int32, np.int64])
                which.append(np.cumsum(step, dtype=np.int64) + np.searchsorted(target, origin))
                window.append(w), length.append(m), low.append(v)
        which, window, length, low = (np.concatenate(v) for v in (which, window, length, low))
        order = np.argsort(which, kind="stable")
        which, window, length, low = (v[order] for v in (which, window, length, low))
        done = 0
        for c, text, first, _, _, _ in parts:
            own = number[done : done + len(first)]
            done += len(first)
            a, b = np.searchsorted(which, own, "left"), np.searchsorted(which, own, "right")
            i = np.repeat(np.arange(len(own)), b - a)
            at = np.repeat(a, b - a) + spread(b - a)
            ok = low[at] < c.doc[text[i]]
            yield c, first[i[ok]] + window[at[ok]], length[at[ok]].astype(np.int64)


def stretches(segment: np.ndarray, n: np.ndarray, most: np.ndarray, low: np.ndarray):
    """(segment, first window, windows, smallest document) of the runs of windows with one smallest document
    that is smaller than the segment's largest. n: windows of the segments; low: by window."""
    own = np.repeat(np.arange(len(n)), n)
    fresh = np.ones(len(low), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(low)))
    keep = low[at] < most[own[at]]
    at, length = at[keep], length[keep]
    return segment[own[at]], spread(n)[at], length, low[at]
