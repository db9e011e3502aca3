"""Language identification by multilingual mixture inference.

Every learned language has a multinomial over hashed character n-grams (bytes, orders 1 to 3, with word
bounds) of its documents. A document is a mixture: each word is written in language k with probability
theta_k, and its likelihood in k follows from its n-grams. Expectation-maximisation estimates theta for
each document; the languages it ranks are then added one by one, each set is fitted by EM alone, and the
set of the greatest log-likelihood less ``PENALTY`` x log(words) per language is selected, of whatever size:
a word's likelihood is at most one, so a size whose penalty alone is beyond the best value found ends the
search. The prediction is the language of the greatest proportion in the set, the score is that proportion.

Counts cover all documents that may be learned from: a task sums vectors of fixed size and sends non-zero
buckets, which are summed by language and bucket. Any number of languages is learned: the model grows with
their names and not with the documents, by ``BUCKETS`` floats (128 KiB) a language, and the texts of a
chunk shrink as the languages grow (``CELLS``), so that a task's matrices keep their size.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is everything if nothing
was learned; words without a letter are passed over; a text whose letters are in no such word is scored by
the languages' shares of the training words; repeated rows are scored each; a null doc_id keeps its
prediction, and its ``held_out`` is null in the query (it may be learned from); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import CHUNK_BYTES, LOWER, SPACE, chunks, hash_words, lut, mix, split_words, spread, texts

BUCKETS = 1 << 15
ROUNDS = 10
SET_ROUNDS = 4
#: Languages x bytes of text handled at once.
CELLS = 8 << 21
PENALTY = 1.0
ALPHA = 0.1

_U = np.uint64
_LETTER = lut([(65, 90), (97, 122), (128, 255)])
_ANY = regex.compile(r"\p{L}")


def words_of(data: np.ndarray, offs: np.ndarray):
    """Lower-cased words that hold a letter byte: the distinct ones' n-gram buckets, each n-gram's word;
    which distinct word each is, and the word offsets of the texts."""
    data = LOWER[data]
    starts, ends, word_offs = split_words(data, offs, SPACE)
    ink = np.concatenate([[0], np.cumsum(_LETTER[data])])
    ok = ink[ends] > ink[starts] if len(starts) else np.zeros(0, bool)
    word_offs = np.concatenate([[0], np.cumsum(ok)])[word_offs]
    starts, ends = starts[ok], ends[ok]
    _, first, which = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
    starts, size = starts[first], (ends - starts)[first]
    place = np.cumsum(size + 2) - (size + 2)  # each word with a bound on either side
    flat = np.zeros(int((size + 2).sum()), np.uint8)
    at = spread(size)
    flat[np.repeat(place + 1, size) + at] = data[np.repeat(starts, size) + at]
    word = np.repeat(np.arange(len(size)), size + 2)
    buckets, owners = [], []
    for order in (1, 2, 3):
        if len(flat) < order:
            continue
        n = len(flat) - order + 1
        key = np.full(n, order, _U)
        for k in range(order):
            key = key << _U(8) | flat[k : k + n].astype(_U)
        inside = word[:n] == word[order - 1 :]
        if order == 1:
            inside &= flat != 0
        buckets.append((mix(key[inside]) >> _U(64 - 15)).astype(np.int64))
        owners.append(word[:n][inside])
    empty = np.zeros(0, np.int64)
    return np.concatenate(buckets) if buckets else empty, np.concatenate(owners) if owners else empty, which, word_offs, len(size)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        for c in chunks(b.column("text")):
            bucket, owner, which, offs, n = words_of(c.data, c.offs)
            own = langs[c.first : c.first + c.rows]
            for lang in set(own):
                at = np.repeat(own == lang, np.diff(offs))
                times = np.bincount(which[at], minlength=n).astype(float)
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket, times[owner], minlength=BUCKETS)
    for lang, v in sums.items():
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(np.rint(v[some]).astype(np.int64))], ["lang", "bucket", "n"])


def learn(docs: DataFrame, eligible: Column | None = None) -> dict:
    """The model of all rows with text and lang (of the eligible ones)."""
    rows = docs.where("text is not null and lang is not null")
    rows = rows if eligible is None else rows.where(eligible)
    sums = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # BUCKETS rows a language at most, whatever the documents
    langs = sorted(set(got.column("lang").to_pylist()))
    count = np.zeros((len(langs), BUCKETS))
    index = {x: i for i, x in enumerate(langs)}
    count[[index[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    total = count.sum(1, keepdims=True)
    return {"langs": langs, "log": np.log((count + ALPHA) / (total + ALPHA * BUCKETS)).astype(np.float32), "share": (total / max(total.sum(), 1))[:, 0]}


def _em(like: np.ndarray, theta: np.ndarray, count: np.ndarray, begin: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (languages x texts) after some rounds; like: languages x words, a word's greatest is one;
    count, begin: words of the texts, none of them empty."""
    for _ in range(rounds):
        r = np.repeat(theta, count, axis=1)
        r *= like
        total = r.sum(0)
        np.maximum(total, 1e-37, out=total)
        r /= total
        theta = np.add.reduceat(r, begin, axis=1, dtype=np.float32) / count.astype(np.float32)
    return theta


def infer(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages, by text."""
    bucket, owner, which, word_offs, n = words_of(data, offs)
    rows, k = len(offs) - 1, len(model["langs"])
    count = np.diff(word_offs)
    own = np.stack([np.bincount(owner, model["log"][i][bucket], minlength=n) for i in range(k)])
    like = np.maximum(np.exp(own - own.max(0)), 1e-30).astype(np.float32)[:, which] if n else np.zeros((k, 0), np.float32)
    some = np.flatnonzero(count)
    chosen = np.zeros((rows, k))
    if len(some):
        words, begin = count[some], word_offs[:-1][some]
        theta = _em(like, np.full((k, len(some)), 1 / k, np.float32), words, begin, ROUNDS)
        rank = np.argsort(-theta, axis=0, kind="stable")
        best, found = np.full(len(some), -np.inf), np.zeros((k, len(some)))
        price = PENALTY * np.log(np.maximum(words, 2))
        live = np.arange(len(some))
        for size in range(1, k + 1):
            more = -price[live] * size > best[live]
            if not more.all():
                live, like = live[more], like[:, np.repeat(more, words[live])]
            if not len(live):
                break
            own, at = words[live], np.cumsum(words[live]) - words[live]
            part = np.zeros((k, len(live)), np.float32)
            np.put_along_axis(part, rank[:size, live], np.take_along_axis(np.maximum(theta[:, live], 1e-6), rank[:size, live], 0), 0)
            part /= part.sum(0)
            if size > 1:
                part = _em(like, part, own, at, SET_ROUNDS)
            mixed = (np.repeat(part, own, axis=1) * like).sum(0)
            value = np.add.reduceat(np.log(np.maximum(mixed, 1e-37)), at, dtype=np.float64) - price[live] * size
            better = value > best[live]
            best[live[better]], found[:, live[better]] = value[better], part[:, better]
        chosen[some] = found.T
    chosen[count == 0] = model["share"]
    return chosen


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, lang_pred, score, languages (the selected set, with proportions)."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = m.value["langs"]
        for b in batches:
            for c in chunks(b.column("text"), min(CHUNK_BYTES, max(1, CELLS // max(len(langs), 1)))):
                share = infer(m.value, c.data, c.offs) if langs else np.zeros((c.rows, 1))
                plain = np.concatenate([[0], np.cumsum(_LETTER[c.data] & (c.data < 128))])[c.offs]
                raw = c.data.tobytes()
                letter = np.array([plain[i + 1] > plain[i] or bool(_ANY.search(raw[c.offs[i] : c.offs[i + 1]].decode())) for i in range(c.rows)], bool) & bool(langs)
                at = share.argmax(1)
                pred = [langs[k] if ok else "und" for k, ok in zip(at, letter)]
                score = np.where(letter, np.clip(share.max(1), 0, 1), 0.0)
                sets = [{langs[k]: float(row[k]) for k in np.flatnonzero(row)} if ok else {} for row, ok in zip(share, letter)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), pa.array(pred, pa.string()), pa.array(score), pa.array([list(x.items()) for x in sets], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = learn(docs, ~F.coalesce(held_out(), F.lit(False)))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
