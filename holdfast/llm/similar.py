"""Near-duplicates by similarity: wide SimHash signatures first, prefixes of the shingle sets for the rest.

Texts are alike if the Jaccard similarity of their sets of ``words``-word shingles is at least
``similarity``; what is linked forms one class. Two searches give candidates, and every candidate is
verified by its shingles.

The first is quick and misses pairs. Signatures have 256 bits, voted by the distinct words, and are cut into
eight 32-bit segments. Two segments that differ by one bit agree in one half of 16 bits, so a signature moves
16 times, keyed by segment, half and the half's value, and the one-wildcard variants of the other half are
indexed and equality-joined where it arrives. Pairs there are compared by the whole signature; of each
variant's group a minimum spanning forest by distance and the star around its middle go on. Copies with
scattered edits are found so; a passage added, cut or replaced in one place can move more bits than
``DISTANCE``, and a forest's edges may fail where other pairs hold.

The second misses none. Under one order of all shingles, two sets of at least ``similarity`` share a shingle
among the first ``n - ceil(similarity x n) + 1`` of each, so these prefixes are exchanged by shingle, and of
every shingle's group all pairs go on whose sizes and places allow the similarity and which verified edges
have not put in one class yet; counts by hash values bound what a pair can have in common, and few are left
to verify. The order puts shingles last that are common in a sample of the texts, so that common passages are
in few prefixes; it decides the cost, never the result.

Defined cases: texts of equal lower-case words are one text (one of none is the empty text); fewer words
than a shingle are one shingle; null reads as empty; repeated rows share a class; class ids are the smallest
doc_id; rows without doc_id are members but never represent a class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, spread_names
from .textcore import LOWER, SPACE, chunks, hash_words, mix, roll, shared_dir, signed, split_words, spread

WORDS, SIMILARITY = 5, 0.8
LANES = 4
SEGMENTS = 2 * LANES
#: Greatest distance of the first search's candidates: pairs at 0.8 differ in about 16 bits by scattered
#: edits, in 30 to 38 by a passage in one place; unrelated texts in 125.
DISTANCE = 36
#: Groups up to this size give all their pairs, larger ones a spanning forest.
SMALL = 8
BUCKETS = 1024
#: Texts whose shingles are counted to tell common ones, how many of the common ones are kept at most, and the
#: counters (a power of two) in which they are. They decide the prefixes' order, so the cost, never the result.
SAMPLE, HOTTEST, HEAT = 8192, 1 << 20, 1 << 22
#: Pairs that are tested at once.
BLOCK = 1 << 20
#: Counters of the sketch of a set of up to ``4 x SKETCH`` shingles; more for larger ones. Sketches bound what two
#: sets can have in common.
SKETCH = 256
#: Bits of the filter by which the texts are chosen whose shingles are wanted (8 MB, however many there are).
BITS = 1 << 26

_U = np.uint64


def _words(column: pa.Array):
    for c in chunks(column):
        data = LOWER[c.data]
        starts, ends, offs = split_words(data, c.offs, SPACE)
        yield c, hash_words(data, starts, ends), offs


def nodes(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hash of the word sequence of each text."""
    n = np.diff(offs)
    key = n.astype(_U)
    some = np.flatnonzero(n)
    if len(some):
        key[some] += np.add.reduceat(mix(h + spread(n).astype(_U) * _U(0x9E3779B97F4A7C15)), offs[:-1][some])
    return mix(key)


def signatures(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """LANES x 64 bits of each text."""
    n = np.diff(offs)
    rows = len(n)
    text = np.repeat(np.arange(rows), n)
    some = np.flatnonzero(n)
    out = np.zeros((rows, LANES), _U)
    if len(some):
        order = np.lexsort((h, text))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        h, text = h[order][fresh], text[order][fresh]
        count = np.bincount(text, minlength=rows)[some]
        begin = np.cumsum(count) - count
        for lane in range(LANES):
            bits = np.unpackbits(mix(h + _U(7919 * lane + 1)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
            out[some, lane] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def shingles(h: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text."""
    rolled = mix(roll(h, words)) if len(h) >= words else h[:0]
    out = []
    for i in range(len(offs) - 1):
        a, b = int(offs[i]), int(offs[i + 1])
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            out.append(mix(roll(h[a:b], b - a)) if b > a else h[:0])
    return out


SIGNED = "doc_id long, node long, sig binary, size int, sketch binary"


def _signed_table(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, h, offs in _words(b.column("text")):
                sets = shingles(h, offs, words)
                columns = [signed(nodes(h, offs)), pa.array([r.tobytes() for r in signatures(h, offs).astype("<u8")], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), *map(pa.array, columns)], ["doc_id", "node", "sig", "size", "sketch"])

    return run


def _far(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sig[a] ^ sig[b]).sum(1, dtype=np.int64)


def _forest(sig: np.ndarray, members: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest of a group under ``DISTANCE`` (Prim), then of the star around its
    middle, the member nearest to all (true in the third array): copies of one text are often nearer to it
    than to each other, but the forest may run along the latter. With sides, forest edges between them."""
    m = len(members)
    total = np.zeros(m, np.int64)
    best, source = np.full(m, DISTANCE + 1), np.zeros(m, np.int64)
    open_ = np.ones(m, bool)
    a, b = [], []
    at = 0
    for _ in range(m):
        open_[at] = False
        d = _far(sig, np.full(m, members[at]), members)
        total[at] = np.minimum(d, DISTANCE + 1).sum()
        nearer = open_ & (d < best)
        if side is not None:
            nearer &= side != side[at]
        best[nearer], source[nearer] = d[nearer], at
        rest = np.where(open_, best, DISTANCE + 2)
        at = int(rest.argmin())
        if rest[at] <= DISTANCE:
            a.append(members[source[at]]), b.append(members[at])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    forest = len(a)
    if side is None:
        middle = np.full(m, members[int(total.argmin())])
        star = (_far(sig, middle, members) <= DISTANCE) & (members != middle)
        a, b = np.concatenate([a, middle[star]]), np.concatenate([b, members[star]])
    return a, b, np.arange(len(a)) >= forest


def spanning(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which edges form a minimum spanning forest (Kruskal)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.lexsort((b, a, distance))
    out = np.zeros(len(a), bool)
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[p], out[i] = q, True
    return out


def candidates(key: np.ndarray, other: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one key whose other halves differ by one bit at most, within ``DISTANCE``: all
    of small groups, the stars of large ones, and one spanning forest of the latter's forests.

    key: segment, half and its value; other: the segment's other 16 bits."""
    n = len(key)
    wild = np.arange(17, dtype=_U)  # 16: none
    mask = ~(_U(1) << np.minimum(wild, _U(15))) & _U(0xFFFF)
    mask[16] = _U(0xFFFF)
    variant = (key[:, None] << _U(21) | wild[None, :] << _U(16) | (other[:, None] & mask[None, :])).reshape(-1)
    entry = np.repeat(np.arange(n), 17)
    order = np.argsort(variant, kind="stable")
    variant, entry = variant[order], entry[order]
    which = ((variant >> _U(16)) & _U(31)).astype(np.int64)
    side = np.where(which < 16, (other[entry] >> np.minimum(which, 15).astype(_U)) & _U(1), _U(2)).astype(np.int64)
    fresh = np.ones(len(variant), bool)
    fresh[1:] = variant[1:] != variant[:-1]
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(variant)))
    a, b = [], []
    for m in range(2, SMALL + 1):
        at = begin[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                x, y = at + i, at + j
                ok = (side[x] != side[y]) | (side[x] == 2)
                a.append(entry[x[ok]]), b.append(entry[y[ok]])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    near = _far(sig, a, b) <= DISTANCE
    parts = [(a[near], b[near], np.ones(int(near.sum()), bool))]
    for at, m in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
        sides = side[at : at + m]
        if sides[0] == 2:
            parts.append(_forest(sig, entry[at : at + m], None))
        elif sides.min() != sides.max():
            parts.append(_forest(sig, entry[at : at + m], sides))
    a, b, keep = (np.concatenate([p[i] for p in parts]) for i in range(3))
    forest = np.flatnonzero(~keep)
    keep[forest[spanning(a[forest], b[forest], _far(sig, a[forest], b[forest]))]] = True
    return a[keep], b[keep]


def _joined(table: pa.Table) -> pa.Table:
    """Edges of one bucket: entries are (node, sig, part) with part = 2 x segment + half."""
    node = table.column("node").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(-1, LANES)
    part = table.column("part").to_numpy().astype(np.int64)
    segment = sig.view("<u4")[np.arange(len(node)), part >> 1].astype(_U)
    shift = ((part & 1) * 16).astype(_U)
    own, other = (segment >> shift) & _U(0xFFFF), (segment >> (_U(16) - shift)) & _U(0xFFFF)
    a, b = candidates(part.astype(_U) << _U(16) | own, other, sig)
    low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    pairs = np.unique(np.stack([low, high], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def candidate_edges(distinct: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(u, v) of ``distinct(node, sig)``."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1))).alias("part")
    moved = distinct.select("node", "sig", parts)
    # bytes of the half: segment s is bytes 4s .. 4s + 3, little endian
    half = F.hex(F.substring("sig", F.col("part") * 2 + 1, F.lit(2)))
    moved = moved.withColumn("bucket", F.pmod(F.xxhash64("part", half), F.lit(buckets)))
    return moved.groupBy("bucket").applyInArrow(_joined, "u long, v long").distinct()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return at, signed(np.concatenate(sets)) if sets and at[-1] else np.zeros(0, np.int64)


def _shingled(words: int, wanted):
    """The sets of the texts that the filter lets pass, and of those without doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").fill_null(0).to_numpy(zero_copy_only=False)
            ok = (wanted.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool) | b.column("place").is_null().to_numpy(zero_copy_only=False)
            for c, h, offs in _words(b.filter(pa.array(ok)).column("text")):
                at, flat = _flat(shingles(h, offs, words))
                yield pa.RecordBatch.from_arrays([pa.array(signed(nodes(h, offs))), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["node", "shingles"])

    return run


def _place(id: Column) -> Column:
    return F.when(id.isNotNull(), F.pmod(F.xxhash64(id), F.lit(BITS)))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for the place of every id of the first column; other ids share a bit now and then."""
    at = ids.where(ids[0].isNotNull()).select((_place(ids[0]) + 1).alias("at"))
    found = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros((BITS >> 15, 4096), np.uint8)
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist()):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, offs in _words(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(_flat(shingles(h, offs, words))[1])], ["token"])

    return run


def _counter(s: np.ndarray) -> np.ndarray:
    return (s & _U(HEAT - 1)).astype(np.int64)


def heat(narrow: DataFrame, distinct: DataFrame, words: int) -> np.ndarray:
    """By counter the power of two of the texts of a sample that hold a shingle, 0 for shingles of less than three.

    The sample are the texts of the smallest ``node``, a hash; ids of more texts than one bring them all."""
    ids = distinct.where("rep is not null").orderBy("node").select(F.col("rep").alias("__hf_id")).limit(SAMPLE)
    found = narrow.join(F.broadcast(ids), F.col("doc_id") == F.col("__hf_id"), "left_semi").select("text").mapInArrow(_tokens(words), "token long")
    rows = found.groupBy("token").agg(F.count("*").alias("count")).where("count > 2").orderBy(F.desc("count"), "token").limit(HOTTEST).toArrow()
    out = np.zeros(HEAT, np.uint8)
    np.maximum.at(out, _counter(rows.column("token").to_numpy().view(_U)), np.log2(rows.column("count").to_numpy()).astype(np.uint8))
    return out


def prefix(s: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, of which a set as similar has at least one among its own."""
    order = np.lexsort((s, level[_counter(s)]))
    return s[order[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]]


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall on each counter, up to 255."""
    bits = int(np.log2(SKETCH)) + max(0, int(np.ceil(np.log2(max(len(s), 1) / (4 * SKETCH)))))
    return np.minimum(np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def can_be_alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles with the sketches x and y can be as similar: what they have in
    common is at most the sum of the lesser counts, and what the counters could not hold."""
    size = min(x.shape[1], y.shape[1])
    x, y = (v.reshape(len(v), size, -1).sum(2, dtype=np.int32) for v in (x, y))  # neighbours of the finer one together
    beyond = np.minimum(n - x.sum(1, dtype=np.int64), m - y.sum(1, dtype=np.int64))
    common = np.minimum(x, y).sum(1, dtype=np.int64) + beyond
    return (1 + similarity) * common >= similarity * (n + m) - 1e-6


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.array(b.column(k).to_pylist(), object) for k in ("x", "y"))
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in ("n", "m"))
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y)])
            ok = np.zeros(b.num_rows, bool)
            for p, q in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == (p, q)).all(1))
                part = (np.frombuffer(b"".join(v[at]), np.uint8).reshape(len(at), -1) for v in (x, y))
                ok[at] = can_be_alike(*part, n[at], m[at], similarity)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return run


def _prefixed(words: int, similarity: float, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, h, offs in _words(b.column("text")):
                sets = shingles(h, offs, words)
                first = [prefix(s, level.value, similarity).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(signed(nodes(h, offs))), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.binary())], ["node", "size", "first"])

    return run


#: apart: component and node differ in these bits; mostly none, which takes few bytes.
POSTING = "token long, before long, node long, apart long, size int, place int"
_POSTING = [x.split()[0] for x in POSTING.split(", ")]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = [np.frombuffer(x, np.int64) for x in b.column("first").to_pylist()]
        n = np.array([len(x) for x in first], np.int64)
        token = np.concatenate([*first, np.zeros(0, np.int64)])
        place, text = spread(n), np.repeat(np.arange(len(n)), n)
        before = np.where(place > 0, np.roll(token, 1), 0)
        node, component, size = (b.column(x).to_numpy(zero_copy_only=False)[text] for x in ("node", "component", "size"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, before, node, node ^ component, size, place.astype(np.int32))], _POSTING)


def prefix_pairs(post: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one token and different components that can be alike, in blocks; postings are whole
    groups, a node once in each. A pair whose tokens before are equal is left to an earlier token."""
    order = np.lexsort((post["size"], post["token"]))
    token, before, node, apart, size, place = (post[x][order] for x in _POSTING)
    component = node ^ apart
    size, place = size.astype(np.int64), place.astype(np.int64)
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    end = np.append(np.flatnonzero(fresh), len(token))[np.cumsum(fresh)]
    # partners of an entry: those after it in its group that are not too large
    top = np.maximum(np.floor(size / similarity + 1e-9).astype(np.int64), size)
    group, width = np.cumsum(fresh), int(size.max(initial=0)) * 2 + 2
    last = np.minimum(np.searchsorted(group * width + size, group * width + np.minimum(top, width - 1), "right"), end)
    begin = np.flatnonzero(fresh)
    mixed = np.maximum.reduceat(component, begin) != np.minimum.reduceat(component, begin) if len(begin) else np.zeros(0, bool)
    todo = np.where(mixed[group - 1], last - np.arange(len(token)) - 1, 0)
    total = np.cumsum(todo)
    at = 0
    while at < len(todo):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BLOCK, "right")))
        a = np.repeat(np.arange(at, to), todo[at:to])
        b = a + 1 + spread(todo[at:to])
        at = to
        ok = (component[a] != component[b]) & ((place[a] == 0) | (place[b] == 0) | (before[a] != before[b]))
        a, b = a[ok], b[ok]
        common = np.minimum(size[a] - place[a], size[b] - place[b])
        ok = (1 + similarity) * common >= similarity * (size[a] + size[b]) - 1e-6
        a, b = a[ok], b[ok]
        if len(a):
            yield np.minimum(node[a], node[b]), np.maximum(node[a], node[b])


def _paired(similarity: float):
    """Batches in the order of their tokens -> candidate pairs."""

    def pairs(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        for u, v in prefix_pairs({x: np.concatenate([p[x] for p in parts]) for x in _POSTING}, similarity):
            both = np.unique(np.stack([u, v], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[dict] = []
        for b in batches:
            if not b.num_rows:
                continue
            post = {x: b.column(x).to_numpy() for x in _POSTING}
            cut = int(np.searchsorted(post["token"], post["token"][-1]))
            if cut or open_ and open_[-1]["token"][-1] != post["token"][0]:
                yield from pairs([*open_, {x: v[:cut] for x, v in post.items()}])
                open_ = []
            open_.append({x: v[cut:] for x, v in post.items()})
        if open_:
            yield from pairs(open_)

    return run


def possible(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sketches allow the similarity; the others are not alike."""
    x = distinct.select(F.col("node").alias("u"), F.col("size").alias("n"), F.col("sketch").alias("x"))
    y = distinct.select(F.col("node").alias("v"), F.col("size").alias("m"), F.col("sketch").alias("y"))
    near = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - F.lit(1e-6)
    return pairs.join(x, "u").join(y, "v").where(near).select("u", "v", "n", "m", "x", "y").mapInArrow(_possible(similarity), "u long, v long")


def remaining_edges(narrow: DataFrame, distinct: DataFrame, linked: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v) of every pair that may share a prefix and is not in one component of ``linked(node, component)``."""
    level = narrow.sparkSession.sparkContext.broadcast(heat(narrow, distinct, words))
    first = narrow.select("text").mapInArrow(_prefixed(words, similarity, level), "node long, size int, first binary").dropDuplicates(["node"])
    named = first.join(linked.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    posted = named.select("node", F.coalesce("component", "node").alias("component"), "size", "first").mapInArrow(_postings, POSTING)
    return posted.repartition("token").sortWithinPartitions("token").mapInArrow(_paired(similarity), "u long, v long").distinct()


def verified(edges: DataFrame, narrow: DataFrame, distinct: DataFrame, words: int, similarity: float) -> DataFrame:
    """The edges whose texts are alike. Only the sets of texts with an edge move: the documents are read through
    a filter of fixed size, and what it lets pass beyond them finds no edge."""
    wanted = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(distinct.select("node", "rep"), "node").select("rep")
    bits = narrow.sparkSession.sparkContext.broadcast(id_filter(wanted))
    sets = narrow.select("text", _place(F.col("doc_id")).alias("place")).mapInArrow(_shingled(words, bits), "node long, shingles array<long>").dropDuplicates(["node"])
    x, y = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)
    return edges.join(x, "u").join(y, "v").where(alike).select("u", "v")


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, class_id) of every row of ``docs``; node tells different texts apart."""
    shared_dir(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = narrow.mapInArrow(_signed_table(words), SIGNED).checkpoint()
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("sig", "size", "sketch")), F.count("*").alias("copies")).checkpoint()
    total, texts = rows.count(), distinct.count()
    files = texts // 200_000 + 1
    edges = possible(candidate_edges(distinct.select("node", "sig"), max(BUCKETS, texts // 100_000)), distinct, similarity).coalesce(files).checkpoint()
    quick = components(verified(edges, narrow, distinct, words, similarity), texts).checkpoint()
    edges = possible(remaining_edges(narrow, distinct, quick, words, similarity), distinct, similarity).checkpoint()
    found = verified(edges, narrow, distinct, words, similarity)
    linked = components(quick.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found), texts).withColumnRenamed("node", "__node")
    member = distinct.select("node", "rep", "copies").join(linked, F.col("node") == F.col("__node"), "left").select("node", "rep", "copies", F.coalesce("component", "node").alias("component"))
    least = member.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("copies"))
    named = spread_names(member, least, "component", "class_id", texts).select("node", "class_id", "copies")
    return spread_names(rows.select("doc_id", "node"), named, "node", "class_id", total)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each class; every column is kept. Rows that
    repeat that doc_id all stay; rows without doc_id stay, for nothing tells them apart."""
    stay = classes(docs, words, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("__hf_id")).distinct()
    return docs.join(stay, docs["doc_id"] == stay["__hf_id"], "left_semi").unionByName(docs.where("doc_id is null"))
