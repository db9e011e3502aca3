"""Substring deduplication by repeated-phrase automata.

1. *Confirm recurring passages.* Blocks of documents find the anchors of their 20-word windows that two
   documents hold (see ``anchors``) and send the words of those runs, as segments, to the bucket of the anchor.
   A shard of a bucket is thus a shard of the phrase table, and of every document all the text in which one of
   its phrases can occur. Windows in segments of two documents are confirmed; where all windows of a segment
   occur in segments of the same content only, the whole segment is one phrase.
2. *Compile sharded automata.* Each shard compiles its phrases into an Aho-Corasick automaton over words, one
   code point per distinct word.
3. *Stream all documents.* The segments of all documents, those of the phrases' own included, run through the
   shard's automaton. Its matches alone say which document has a phrase first, and which words of later ones go.

Windows repeated inside a text are found by an automaton too: the repeated phrases of a chunk's texts are
compiled, the texts run through it, and every match in a text but a phrase's first one covers its words.

Defined cases: null and empty texts have no words and keep the empty string; a null doc_id ranks last;
rows of one doc_id don't precede each other; repeated rows give repeated results; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import HOT, NONE, Exchange, Symbols
from .blocks import Blocks, groups, reduce
from .textcore import SPACE, chunks, covered, hash_words, mix, roll, split_words, spread, texts

WIDTH = 20
GRAM = 8
#: Text of a block that is handled at once; its arrays stay in a core's cache.
SHARD_BYTES = 1 << 18

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_U = np.uint64


def _words(table: pa.Table) -> Iterator[Symbols]:
    d = table.column("d").to_numpy()
    for c in chunks(table.column("text"), SHARD_BYTES):
        starts, ends, offs = split_words(c.data, c.offs, SPACE)
        yield Symbols(c.data, offs, hash_words(c.data, starts, ends), d[c.first : c.first + c.rows], starts, ends, c.first)


def windows_of(offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window of texts with the word offsets."""
    n = np.diff(offs)
    count = np.maximum(n - width + 1, 0)
    return np.repeat(np.arange(len(n)), count), np.repeat(offs[:-1], count) + spread(count)


def _encoded(x: np.ndarray, offs: np.ndarray) -> tuple[str, int]:
    """Texts of words as code points (two for each word where one can't tell them apart), each text with the code
    point 1 behind it, which no word has."""
    values, rank = np.unique(x, return_inverse=True)
    wide = 2 if len(values) > 1_000_000 else 1
    codes = np.zeros((len(x) + len(offs) - 1, wide), np.uint32)
    at = np.arange(len(x)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    codes[at] = (np.stack([rank >> 16, rank & 0xFFFF], 1) if wide == 2 else rank[:, None]) + 1
    codes += 1
    codes[codes >= 0xD800] += np.uint32(0x800)
    return codes.tobytes().decode("utf-32-le"), wide


def occurrences(x: np.ndarray, offs: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence, in the texts ``x[offs[i]:offs[i + 1]]``, of the phrases
    ``x[at[j]:at[j] + size[j]]``: an automaton of the phrases, through which all the texts run."""
    if not len(at):
        return at, at
    code, wide = _encoded(x, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    automaton = ahocorasick.Automaton()
    begin = (at + text[at]) * wide
    for j, (a, b) in enumerate(zip(begin.tolist(), (begin + size * wide).tolist())):
        automaton.add_word(code[a:b], j)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(code)), np.int64).reshape(-1, 2)
    end = found[:, 0] + 1
    phrase = found[:, 1][end % wide == 0]
    place = end[end % wide == 0] // wide - size[phrase]  # among words with an end behind every text
    return phrase, place - np.searchsorted(offs[1:] + np.arange(len(offs) - 1), place, "right")


def phrase_table(x: np.ndarray, offs: np.ndarray, least: np.ndarray, most: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the phrases of segments that two documents hold: an occurrence of each."""
    segment, at = windows_of(offs, width)
    if not len(at):
        return at, at
    key = mix(roll(x, width))[at]
    begin, _ = groups(segment)
    whole = np.add.reduceat(mix(key + spread(np.diff(offs) - width + 1).astype(_U) * _U(0x9E3779B97F4A7C15)), begin)
    _, example, kind = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(key, kind="stable")
    first, run = groups(key[order])
    own, of = segment[order], kind[segment][order]
    twice = np.minimum.reduceat(least[own], first) < np.maximum.reduceat(most[own], first)
    alone = np.minimum.reduceat(of, first) == np.maximum.reduceat(of, first)
    # a content all whose windows occur in it alone is one phrase, if two documents hold it
    single = np.ones(len(example), bool)
    np.logical_and.at(single, of, alone[run])
    held = np.zeros(len(example), bool)
    np.logical_or.at(held, of, twice[run])
    entire = example[single & held]
    part = at[order[first[twice & ~single[of[first]]]]]
    return np.concatenate([offs[:-1][entire], part]), np.concatenate([np.diff(offs)[entire], np.full(len(part), width)])


def matched(data: np.ndarray, offs: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray, width: int) -> np.ndarray:
    """For the windows of a shard's segments the smallest document in which the automaton finds their phrase."""
    starts, ends, words = split_words(data, offs, SPACE)
    x = hash_words(data, starts, ends)
    at, size = phrase_table(x, words, least, most, width)
    phrase, place = occurrences(x, words, at, size)
    segment = np.searchsorted(words, place, "right") - 1
    first = np.full(len(at), NONE)
    np.minimum.at(first, phrase, least[segment])
    low = np.full(int(n.sum()), NONE)
    window = place - segment * (width - 1)  # a segment has so many windows less than words
    count = size[phrase] - width + 1
    np.minimum.at(low, np.repeat(window, count) + spread(count), np.repeat(first[phrase], count))
    return low


def repeated(x: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """Booleans of words covered by windows that start earlier in the same text."""
    gone = np.zeros(len(x), bool)
    text, at = windows_of(offs, width)
    if not len(at):
        return gone
    key = mix(roll(x, width))[at]
    order = np.lexsort((key, text))
    same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    if not same.any():
        return gone
    phrases = np.unique(key[order][1:][same])
    some = np.unique(text[order][1:][same])
    size = np.diff(offs)[some]
    inner = np.concatenate([[0], np.cumsum(size)])
    back = np.repeat(offs[some], size) + spread(size)  # the texts with repeats, one after another
    own, start = windows_of(inner, width)
    value = mix(roll(x[back], width))[start]
    rank = np.searchsorted(phrases, value)
    hit = phrases[np.minimum(rank, len(phrases) - 1)] == value
    _, example = np.unique(rank[hit], return_index=True)
    phrase, place = occurrences(x[back], inner, start[hit][example], np.full(len(example), width))
    whose = np.searchsorted(inner, place, "right") - 1
    order = np.lexsort((place, phrase, whose))
    again = (phrase[order][1:] == phrase[order][:-1]) & (whose[order][1:] == whose[order][:-1])
    later = back[place[order][1:][again]]
    return covered(len(x), later, np.full(len(later), width))


def _removed(exchange: Exchange):
    def f(block, table, mail):
        ids = table.column("doc_id").combine_chunks()
        for (data, offs, x, _, starts, ends, row), window, length in exchange.found(table, mail):
            gone = covered(len(x), window, length + exchange.width - 1) | repeated(x, offs, exchange.width)
            raw, count, digest = data.tobytes(), np.diff(offs), []
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offs])
            for i in range(len(count)):
                keep = np.flatnonzero(~gone[offs[i] : offs[i + 1]]) + offs[i]
                digest.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])).hexdigest())
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(count)), pa.array(count), pa.array(lost), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return f


def dedup_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, **blocks: int) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space). blocks: sizes
    of :class:`Blocks`."""
    dealt_ = Blocks(docs, **blocks)
    exchange = Exchange(width, gram, dealt_.count, dealt_.key_bytes, hot, _words)
    first = reduce(dealt_.send(exchange.announce), exchange.shared)
    second = reduce(dealt_.answer(first, exchange.send), exchange.decide(partial(matched, width=width)))
    return dealt_.answer(first.unionByName(second), _removed(exchange), RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(texts(spark, sf_dir))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) k2 from (select *, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
f as (select doc_id, i, min(doc_id) over (partition by k2) least, min(i) over (partition by k2, doc_id) first from g),
gone as (select distinct doc_id, unnest(range(i, i + 20)) j from f where doc_id > least or i > first),
kept as (select l.doc_id, string_agg(t, ' ' order by l.j) t from (select doc_id, unnest(w) t, unnest(range(1, len(w) + 1)) j from d) l anti join gone on l.doc_id = gone.doc_id and l.j = gone.j group by 1),
n as (select doc_id, count(*) n from gone group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""
