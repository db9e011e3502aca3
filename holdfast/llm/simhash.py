"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Fingerprints at three or fewer differing bits have a half
that differs in one bit at most, so they share that half, or the half with one position wildcarded. Each
distinct fingerprint is indexed under 2 whole halves and 2 x 32 one-wildcard halves; the equality join
pairs a wildcarded 0 with a wildcarded 1 only, so a pair is found about once, and the full distance is
verified in the join. Copies share a fingerprint and are one index entry, whatever their number.

Defined cases: null and empty texts (and texts without words) have fingerprint zero, linked like any
other; fewer words than a shingle form one shingle; repeated rows give repeated results; a component's id
is the smallest non-null doc_id in it; further columns are ignored, or kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, spread_names
from .textcore import LOWER, SPACE, chunks, shared_dir, split_words, spread, texts

DISTANCE = 3
SHINGLE = 3
SEED = 42


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, unsigned fingerprints) of each chunk."""
    for c in chunks(column):
        data = LOWER[c.data]
        starts, ends, offs = split_words(data, c.offs, SPACE)
        size, n = ends - starts, np.diff(offs)
        place = np.cumsum(size + 1) - size - 1  # of each word in the words joined by one space
        flat = np.full(int((size + 1).sum()), 32, np.uint8)
        at = spread(size)
        flat[np.repeat(place, size) + at] = data[np.repeat(starts, size) + at]
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        begin = np.repeat(offs[:-1], count) + spread(count)
        last = begin + np.repeat(np.minimum(n, shingle), count) - 1
        text, digest = flat.tobytes(), xxhash.xxh64_intdigest
        a, b = place[begin].tolist(), (place[last] + size[last]).tolist()
        h = np.fromiter((digest(text[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
        out = np.zeros(c.rows, np.uint64)
        some = np.flatnonzero(count)
        if len(some):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
            out[some] = np.packbits(2 * ones > count[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        yield c.first, out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, fp in fingerprints_of(b.column("text"), shingle):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(fp)), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints ``fp`` at ``DISTANCE`` or fewer differing bits."""
    variants = F.expr("""
        flatten(transform(array(fp & 4294967295L, shiftrightunsigned(fp, 32)), (h, s) ->
            concat(array(struct(shiftleft(cast(s * 33 + 32 as bigint), 32) | h as k, -1 as bit)),
                   transform(sequence(0, 31), i -> struct(
                       shiftleft(cast(s * 33 + i as bigint), 32) | (h & ~shiftleft(1L, i)) as k,
                       cast(shiftright(h, i) & 1L as int) as bit)))))""")
    index = distinct.select("fp", F.inline(variants).alias("k", "bit"))
    # a key with a wildcard meets its own kind only, and there left has the bit 0 and right 1
    left, right = index.where("bit <= 0").alias("x"), index.where("bit <> 0").alias("y")
    return left.join(right, F.expr(f"x.k = y.k and (x.bit = 0 or x.fp < y.fp) and bit_count(x.fp ^ y.fp) <= {DISTANCE}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``. What a later plan holds more than once is cut."""
    shared_dir(docs.sparkSession)
    prints = fingerprints(docs, shingle).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).checkpoint()
    found = links(distinct.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    different, total = distinct.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    linked = components(found, different, spread=True).withColumnRenamed("node", "fp")
    least = linked.join(distinct, "fp").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("copies")).checkpoint()
    label = spread_names(linked, least, "component", "component_id", different).select("fp", "component_id")
    named = distinct.join(label, "fp", "left").select("fp", "copies", F.coalesce("component_id", "rep").alias("component_id")).checkpoint()
    return spread_names(prints, named, "fp", "component_id", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id; every column is kept.

    Rows that repeat that doc_id all stay; rows without doc_id stay, for nothing tells them apart."""
    stay = classes(docs, shingle).where("doc_id = component_id").select(F.col("doc_id").alias("__hf_id")).distinct()
    return docs.join(stay, docs["doc_id"] == stay["__hf_id"], "left_semi").unionByName(docs.where("doc_id is null"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(texts(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
