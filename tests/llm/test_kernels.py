import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from holdfast.llm import anchors, blocks, decontaminate, packing, suffixes, textcore

from brute import ALNUM, SPACE, lower

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t日", max_size=60)), max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_and_hashes(texts):
    seen = {}
    for limit in (1, 50, 1 << 20):
        got = []
        for c in textcore.chunks(pa.array(texts, pa.string()), limit):
            starts, ends, offs = textcore.split_words(c.data, c.offs, textcore.SPACE)
            h = textcore.hash_words(c.data, starts, ends)
            raw = c.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts, ends)]
            for w, x in zip(words, h.tolist()):
                assert seen.setdefault(w, x) == x
            got += [words[offs[i] : offs[i + 1]] for i in range(c.rows)]
        assert got == [SPACE.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_alphanumeric_words():
    t = "A-b  c_D 9! é,x\x00y"
    c = next(textcore.chunks(pa.array([t])))
    data = textcore.LOWER[c.data]
    s, e, _ = textcore.split_words(data, c.offs, textcore.NON_ALNUM)
    assert [data.tobytes()[a:b].decode() for a, b in zip(s, e)] == ALNUM.findall(lower(t))


def test_sliced_columns():
    col = pa.array(["aa", None, "b b", "c"])[1:3]
    assert [(c.first, c.rows, c.data.tobytes()) for c in textcore.chunks(col)] == [(0, 2, b"b b")]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 13))
def test_rolls_and_minima(values, width):
    x = np.array(values, np.uint64)
    rolled = textcore.roll(x, width)
    windows = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(rolled) == max(0, len(windows)) and len(set(rolled.tolist())) == len(set(windows))
    if windows:
        assert textcore.sliding_min(x, width).tolist() == [min(w) for w in windows]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5))
def test_runs_cover_each_window_once(texts):
    x = textcore.mix(np.array([v for t in texts for v in t], np.uint64))
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text, first, n, anchor, content, window = anchors.runs(x, offs, 6, 3)
    covered = sorted(i for a, k in zip(first.tolist(), n.tolist()) for i in range(a, a + k))
    assert covered == [i for t in range(len(texts)) for i in range(offs[t], max(offs[t], offs[t + 1] - 5))]
    by_window, by_content = {}, {}
    flat = [v for t in texts for v in t]
    for a, k, m, c in zip(first.tolist(), n.tolist(), anchor.tolist(), content.tolist()):
        whole = tuple(flat[a : a + k + 5])
        assert by_content.setdefault(c, whole) == whole
        for i in range(a, a + k):  # equal windows have equal anchors
            assert by_window.setdefault(tuple(flat[i : i + 6]), m) == m


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="ab", min_size=60, max_size=200), st.integers(1, 50))
def test_deep_shallow_order(text, depth):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(data) - depth + 1)
    order, part = suffixes.deep_shallow(data, starts, depth)
    keys = [text[i : i + depth] for i in starts]
    assert [keys[i] for i in order] == sorted(keys)
    assert all((a == b) == (keys[i] == keys[j]) for i, j, a, b in zip(order, order[1:], part, part[1:]))


def test_deep_shallow_on_nothing():
    order, part = suffixes.deep_shallow(np.zeros(0, np.uint8), np.zeros(0, np.int64), 5)
    assert len(order) == len(part) == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_suffix_array(values, depth):
    x = np.array(values, np.uint64)
    sa = decontaminate.suffix_array(x, depth)
    keys = [tuple(values[i : i + depth]) for i in range(len(values))]
    assert [keys[i] for i in sa] == sorted(keys)


def test_messages():
    key = np.array([5, 1 << 40, 7], np.uint64)
    p = blocks.packed(blocks.short(key, 6), np.array([1, 2, 3], np.int32), np.array([0, 1, 0], np.uint8))
    got = blocks.gathered([p, p], [6, np.int32, np.uint8])
    assert got[0].tolist() == key.tolist() * 2 and got[1].tolist() == [1, 2, 3] * 2 and got[3].tolist() == [0] * 3 + [1] * 3
    dealt = blocks.dealt(4, 9, np.array([2, 1, 2]), key).to_pylist()
    assert [(m["target"], m["origin"], blocks.unpacked(m["payload"], [np.uint64])[0].tolist()) for m in dealt] == [(1, 9, [1 << 40]), (2, 9, [5, 7])]


def test_messages_grow_with_the_text():
    """One message for so many bytes of text, although every block writes to every bucket."""
    for size in (1 << 28, 1 << 32, 1 << 36, 1 << 40):
        assert abs(blocks.number(size) ** 2 * blocks.MESSAGE_BYTES / size - 1) < 0.01
    assert blocks.number(100 << 40) * blocks.BLOCK_BYTES == 100 << 40 and blocks.number(0) == blocks.LEAST


def test_messages_never_outnumber_entries():
    """Blocks far smaller than their messages want: what grows with the square is cut by what there is to send."""
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(300)).decode() for _ in range(120)]
    for count in (50, 700, 5000):
        e = anchors.Exchange(50, 16, count, 8, 4096, suffixes._bytes)
        sent = entries = 0
        for i, t in enumerate(texts):
            for m in e.announce(i, pa.table({"text": [t], "d": [i]})):
                sent += m.num_rows
                entries += sum(int(np.frombuffer(p.as_py(), np.int64, 1)[0]) for p in m.column("payload"))
        assert sent <= entries <= 120 * 301 and sent <= 120 * count


def test_best_fit_respects_every_capacity():
    rng = random.Random(5)
    for rule in ("norm", "dot"):
        for tokens, docs, cost in ((100, 100, 10_000), (100, 3, 10_000), (100, 100, 5_000)):
            n = np.array([rng.randint(1, 70) for _ in range(300)])
            where, offset = packing.best_fit(n, tokens, docs, cost, rule=rule)
            for b in set(where.tolist()):
                own = where == b
                assert n[own].sum() <= tokens and own.sum() <= docs and (n[own] ** 2).sum() <= cost
                at = np.argsort(offset[own])
                assert (offset[own][at] == np.concatenate([[0], np.cumsum(n[own][at])[:-1]])).all()
            if docs == 100 and cost == 10_000:
                assert len(set(where.tolist())) <= 1.06 * np.ceil(n.sum() / tokens)
    assert len(packing.best_fit(np.zeros(0, np.int64))[0]) == 0


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(3, 1024) == [(0, 3)]
