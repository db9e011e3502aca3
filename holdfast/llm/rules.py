"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio against the raw corpus.

Two multinomials over hashed n-grams are kept for the trusted target (labelled documents of quality 1)
and for the raw corpus (all documents): byte 3-grams of the text, and pairs of neighbouring words by shape
(runs of upper case, lower case, digits, each other byte) and equality. A document's score is the sum over
the two kinds of its mean log ratio target : raw, so it doesn't depend on length; a document is kept if it
passes the base rules and the score is at least ``THRESHOLD``, the same for every document and corpus.

Both counts are whole: the raw one covers every document, the target every document with a label of quality
1, found by an ordinary join by doc_id. Each task sums vectors of fixed size and sends their non-zero buckets,
which are summed by bucket. The model is ``BUCKETS`` floats.

Defined cases: null and empty texts have no words and fail the base rules; without any target document the
ratio is zero everywhere and the base rules alone decide; repeated rows are scored each; further columns
are ignored, or kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import line_bounds
from .textcore import SPACE, chunks, covered, hash_words, lut, mix, roll, split_words, spread, texts

GRAMS, PAIRS = 1 << 16, 1 << 14
BUCKETS = GRAMS + PAIRS
THRESHOLD = -0.5
ALPHA = 0.5
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"

_U = np.uint64
_SYMBOL = lut([(ord(c), ord(c)) for c in SYMBOLS])
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])


def base(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; words and their hashes."""
    starts, ends, word_offs = split_words(data, offs, SPACE)
    h = hash_words(data, starts, ends)
    n = np.diff(word_offs)
    chars = _per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offs)
    symbols = _per_text(_SYMBOL[data], offs)
    line_starts, line_ends, line_offs = line_bounds(data, offs)
    ink = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = ink[line_ends] > ink[line_starts]
    text = np.repeat(np.arange(len(n)), np.diff(line_offs))[full]
    key = hash_words(data, line_starts[full], line_ends[full]) + text.astype(_U) * _U(0xD6E8FEB86659FD93)
    distinct = np.bincount(text[np.unique(key, return_index=True)[1]], minlength=len(n)) if len(key) else np.zeros(len(n), np.int64)
    lines = np.bincount(text, minlength=len(n)) - distinct
    window = roll(h, WINDOW)
    count = np.maximum(n - WINDOW + 1, 0)
    at = np.repeat(word_offs[:-1], count) + spread(count)
    key = mix(window[at]) + np.repeat(np.arange(len(n)), count).astype(_U) * _U(0xD6E8FEB86659FD93)
    _, which, times = np.unique(key, return_inverse=True, return_counts=True) if len(key) else (key, at, at)
    again = at[times[which] > 1] if len(key) else at
    repeated = _per_text(covered(len(h), again, np.full(len(again), WINDOW)), word_offs)
    return n, chars, symbols, lines, repeated, (starts, ends, word_offs, h)


def grams(data: np.ndarray, offs: np.ndarray, words) -> tuple[np.ndarray, ...]:
    """Buckets of byte 3-grams and of word pairs, each with the text they are in."""
    starts, ends, word_offs, h = words
    b = data.astype(np.uint32)
    three = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16) if len(b) > 2 else np.zeros(0, np.uint32)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = text[:-2] == text[2:] if len(b) > 2 else np.zeros(0, bool)
    kind = SHAPE[data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[starts] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    shape = hash_words(kind[fresh], place[starts], place[ends])
    word_text = np.repeat(np.arange(len(offs) - 1), np.diff(word_offs))
    pair = np.flatnonzero(word_text[1:] == word_text[:-1]) if len(h) else np.zeros(0, np.int64)
    both = mix(shape[pair] * _U(0x9E3779B97F4A7C15) + shape[pair + 1] + (h[pair] == h[pair + 1]).astype(_U))
    return three[inside].astype(np.int64), text[:-2][inside] if len(b) > 2 else text[:0], (both >> _U(50)).astype(np.int64) + GRAMS, word_text[pair]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: bucket, count in the target, count in the raw corpus."""
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        trusted = np.asarray(b.column("trusted"), bool)
        for c in chunks(b.column("text")):
            starts, ends, word_offs = split_words(c.data, c.offs, SPACE)
            three, t3, pair, t2 = grams(c.data, c.offs, (starts, ends, word_offs, hash_words(c.data, starts, ends)))
            own = trusted[c.first : c.first + c.rows]
            raw += np.bincount(three, minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)
            if own.any():
                target += np.bincount(three[own[t3]], minlength=BUCKETS) + np.bincount(pair[own[t2]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios target : raw by bucket."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__hf_id")).distinct()
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # one way of joining at every size: the texts move once by id, unsorted, against partitions of bare ids
    flagged = narrow.where("doc_id is not null").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("__hf_id"), "left").select("text", F.col("__hf_id").isNotNull().alias("trusted"))
    flagged = flagged.unionByName(narrow.where("doc_id is null").select("text", F.lit(False).alias("trusted")))  # not one task's in the join
    rows = flagged.mapInArrow(_counts, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows.column("bucket").to_numpy()
    target[at], raw[at] = rows.column("target").to_numpy(), rows.column("raw").to_numpy()
    out = np.zeros(BUCKETS, np.float32)
    for part in (slice(0, GRAMS), slice(GRAMS, BUCKETS)):
        t, r = target[part] + ALPHA, raw[part] + ALPHA
        if target[part].sum():
            out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def judged(ratio: np.ndarray, data: np.ndarray, offs: np.ndarray):
    """The base figures, base_failed, score and kept of each text."""
    n, chars, symbols, lines, repeated, words = base(data, offs)
    three, t3, pair, t2 = grams(data, offs, words)
    rows = len(n)
    score = np.zeros(rows)
    for bucket, text in ((three, t3), (pair, t2)):
        total = np.bincount(text, minlength=rows)
        score += np.bincount(text, ratio[bucket], minlength=rows) / np.maximum(total, 1)
    failed = (n < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
    return n, chars, symbols, lines, repeated, failed, score, ~failed & (score >= THRESHOLD)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def rules(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Per row: doc_id, the base figures, base_failed, score, kept."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                n, chars, symbols, lines, repeated, failed, score, kept = judged(model.value, c.data, c.offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), *(pa.array(x.astype(np.int64)) for x in (n, chars, symbols, lines, repeated)), pa.array(failed), pa.array(score), pa.array(kept)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` without the rows that the rules reject; every column is kept."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [judged(model.value, c.data, c.offs)[-1] for c in chunks(b.column("text"))]
            if parts:
                yield b.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return rules(docs, learn(docs, texts(spark, sf_dir, "labels")))


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures and the base rules' verdict of every document, without the ratio."""
    return rules(texts(spark, sf_dir), np.zeros(BUCKETS, np.float32)).select(BASE)


BASE_ORACLE = r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
g as (select doc_id, i, count(*) over (partition by doc_id, k) c from (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 7), ' ')) k from (select *, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8))),
r as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + 8)) j from g where c > 1) group by 1),
b as (select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(coalesce(l.n, 0) as bigint) n_dup_lines, cast(coalesce(r.n, 0) as bigint) n_repeat_words from d left join l using (doc_id) left join r using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from b
"""
