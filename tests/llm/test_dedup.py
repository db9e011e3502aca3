import functools
import re

import brute
import numpy as np
import pyarrow as pa
from holdfast.llm import anchors, decontaminate, lines, phrases, rules, similar, simhash, suffixes
from holdfast.llm.components import components
from pyspark.sql import functions as F

from oracle import SF, assert_equal


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def by_repr(x):
    return sorted(x, key=repr)


P = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_phrases(docs, corpus, empty):
    want = by_repr(brute.phrases(corpus))
    assert rows(phrases.dedup_phrases(docs), *P) == want
    assert rows(phrases.dedup_phrases(docs, hot=2), *P) == want  # most anchors are crowded: windows travel alone
    assert phrases.dedup_phrases(empty).count() == 0


def test_phrases_of_other_width(docs, corpus):
    assert rows(phrases.dedup_phrases(docs, 5, 2), *P) == by_repr(brute.phrases(corpus, 5))


def test_phrases_in_many_small_shards(docs, corpus, monkeypatch):
    monkeypatch.setattr(anchors, "SHARD", 1)
    want = by_repr(brute.phrases(corpus))
    assert rows(phrases.dedup_phrases(docs, least=3), *P) == want
    assert rows(phrases.dedup_phrases(docs, block_bytes=300), *P) == want  # more blocks than documents


def test_the_automaton_decides(docs, corpus, monkeypatch):
    """Without its automata the operator removes nothing."""

    class Nothing:
        def add_word(self, *_):
            pass

        def make_automaton(self):
            pass

        def iter(self, _):
            return []

    short = [r for r in corpus if r[0] != 505]
    data, offs, x, doc, *_ = next(phrases._words(pa.table({"text": [t for _, t in short], "d": [brute.rank(i) for i, _ in short]})))
    monkeypatch.setattr(phrases.ahocorasick, "Automaton", Nothing)
    assert not phrases.repeated(x, offs, 20).any()
    text = ("a b c d e f " * 4).encode()
    segment = np.frombuffer(text * 2, np.uint8)
    args = segment, np.array([0, len(text), 2 * len(text)]), np.array([5, 5]), np.array([1, 2]), np.array([1, 2])
    assert (phrases.matched(*args, 20) == anchors.NONE).all()
    monkeypatch.undo()
    assert (phrases.matched(*args, 20) == 1).all() and phrases.repeated(x, offs, 20).any()


def test_equal_hashes_do_not_remove(docs, corpus, monkeypatch):
    """Names and contents only choose what meets: with one name for all of an anchor the texts still decide."""
    plain = anchors.runs

    def blurred(x, offs, width, gram):
        text, first, n, anchor, content, window = plain(x, offs, width, gram)
        return text, first, n, np.full_like(anchor, 7), content, window

    monkeypatch.setattr(anchors, "runs", blurred)  # every anchor is one: all segments meet in one shard
    short = [r for r in corpus if r[0] != 505]
    data, offs, x, doc, starts, ends, _ = next(phrases._words(pa.table({"text": [t for _, t in short], "d": [brute.rank(i) for i, _ in short]})))
    table = pa.table({"text": [t for _, t in short], "d": [brute.rank(i) for i, _ in short], "doc_id": pa.array([i for i, _ in short], pa.int64())})
    for module, read, method, want in ((phrases, phrases._words, phrases.matched, brute.phrases(short)), (suffixes, suffixes._bytes, suffixes.classes, brute.suffixes(short))):
        width, gram = module.WIDTH, module.GRAM
        e = anchors.Exchange(width, gram, 1, 8, 1 << 40, read)
        first = [m for b in e.announce(0, table) for m in b.to_pylist()]
        second = [m for b in e.shared(0, np.zeros(len(first), np.int64), [m["payload"] for m in first]) for m in b.to_pylist()]
        mail = [(m["kind"], m["origin"], m["payload"]) for m in second]
        sent = [m for b in e.send(0, table, mail) for m in b.to_pylist()]
        spans = [m for b in e.decide(functools.partial(method, width=width))(0, np.zeros(len(sent), np.int64), [m["payload"] for m in sent]) for m in b.to_pylist()]
        got = [r for b in module._removed(e)(0, table, mail + [(m["kind"], m["origin"], m["payload"]) for m in spans]) for r in zip(*b.to_pydict().values())]
        assert by_repr(got) == by_repr(want)


def test_wide_alphabet():
    x = np.arange(1_000_002, dtype=np.uint64)
    code, wide = phrases._encoded(x, np.array([0, 5, len(x)]))
    assert wide == 2 and len(code) == 2 * (len(x) + 2) and code[:4] != code[2:6] and code[10:12] == "\x01\x01"
    phrase, place = phrases.occurrences(np.concatenate([x, x[5:]]), np.array([0, 5, len(x), 2 * len(x) - 5]), np.array([7]), np.array([3]))
    assert sorted(place.tolist()) == [7, len(x) + 2] and phrase.tolist() == [0, 0]


S = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffixes(docs, corpus, empty):
    small = [r for r in corpus if r[0] != 505]
    few = docs.where("doc_id is null or doc_id <> 505")
    want = by_repr(brute.suffixes(small))
    assert rows(suffixes.dedup_bytes(few), *S) == want
    assert rows(suffixes.dedup_bytes(few, hot=2), *S) == want  # most anchors are crowded: windows travel alone
    assert suffixes.dedup_bytes(empty).count() == 0


def test_suffixes_of_other_width(docs, corpus):
    small = [r for r in corpus if r[0] != 505]
    assert rows(suffixes.dedup_bytes(docs.where("doc_id is null or doc_id <> 505"), 21, 6), *S) == by_repr(brute.suffixes(small, 21))


def test_suffixes_in_many_small_shards(docs, corpus, monkeypatch):
    small = [r for r in corpus if r[0] not in (505, 402, 403)]
    few = docs.where("doc_id is null or doc_id not in (505, 402, 403)")
    monkeypatch.setattr(anchors, "SHARD", 1)
    assert rows(suffixes.dedup_bytes(few, block_bytes=400), *S) == by_repr(brute.suffixes(small))


def test_the_sort_decides(monkeypatch):
    """Without the sort's classes nothing is removed, copies included."""
    text = np.frombuffer(bytes(range(60)) * 2, np.uint8)
    args = text, np.array([0, 60, 120]), np.array([11, 11]), np.array([1, 2]), np.array([1, 2])
    assert (suffixes.classes(*args, 50) == 1).all()
    monkeypatch.setattr(suffixes, "deep_shallow", lambda data, starts, depth: (np.arange(len(starts)), np.arange(len(starts))))
    low = suffixes.classes(*args, 50)
    assert not len(anchors.stretches(np.arange(2), args[2], args[4], low)[0])


L = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def test_lines(docs, corpus, empty):
    assert rows(lines.line_report(docs), *L) == by_repr(brute.lines(corpus))
    out = lines.dedup(docs)
    assert out.schema == docs.schema
    want = by_repr((i, None if t is None else h) for (i, t), (_, _, _, h) in zip(corpus, brute.lines(corpus)))
    assert by_repr((i, None if t is None else brute.sha(t)) for i, t in rows(out, "doc_id", "text")) == want
    assert lines.dedup(empty).count() == 0 and lines.line_report(empty).count() == 0


def test_null_text_stays_null(docs):
    assert lines.dedup(docs).where("doc_id = 500 and text is null").count() == 2


D = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items(spark, corpus):
    texts = {i: t for i, t in corpus if t}
    found = [(1, texts[200][:400]), (2, "nothing of the kind is here or there at all in any text"), (3, "Two words"), (4, None), (5, ""), (10, texts[0][:150]), (11, texts[0][:150]), (12, "one"), (10, texts[0][:150]), (12, texts[200][500:900]), (None, texts[3]), (None, texts[3]), (None, None)]
    return found, spark.createDataFrame([(i, t, 9) for i, t in found], "item_id long, text string, key int")


def test_contamination(spark, docs, corpus, empty, monkeypatch):
    found, benchmark = items(spark, corpus)
    want = by_repr(brute.contamination(corpus, found))
    assert rows(decontaminate.digest(decontaminate.contamination(docs, benchmark)), *D) == want
    clean = decontaminate.remove_contaminated(docs, benchmark)
    assert clean.schema == docs.schema and clean.count() == sum(not r[-1] for r in want)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.digest(decontaminate.contamination(docs, benchmark.limit(0))).where("contaminated").count() == 0
    for size, alive in ((100, 2), (400, 100)):  # passes over several blocks, with and without a cut between them
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "ALIVE", alive)
        assert len(list(decontaminate._blocks(benchmark, 10))) > 2
        assert rows(decontaminate.digest(decontaminate.contamination(docs, benchmark)), *D) == want
    again = decontaminate.remove_contaminated(docs, benchmark)
    assert again.schema == docs.schema and again.count() == clean.count()


def test_share_of_hits_is_over_all_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20] + ["x"] * 60))], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", " ".join(words[:12])), ("b", " ".join(words[20:34]))], "item_id string, text string")
    for size in (1, 1 << 20):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        left = lambda share: [r.doc_id for r in decontaminate.remove_contaminated(docs, benchmark, least_share=share).collect()]
        assert left(0.0) == [] and left(0.6) == [2] and left(0.7) == [1, 2]


def test_an_item_without_id_contaminates(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    got = rows(decontaminate.digest(decontaminate.contamination(docs, spark.createDataFrame([(None, words)], "item_id string, text string"))), *D)
    assert got == [(1, 12, 12, 1, brute.sha(""), True)]


def test_longest_matches(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words[5:30]) + " y " + " ".join(words[:12])), (2, "z")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", " ".join(words)), ("b", "z")], "item_id string, text string")
    got = rows(decontaminate.verbatim_matches(docs, benchmark), "doc_id", "item_id", "item_word", "doc_word", "n_words")
    assert got == [(1, "a", 0, 27, 12), (1, "a", 5, 1, 25), (2, "b", 0, 0, 1)]


def test_simhash(docs, corpus, empty):
    prints = [(i, brute.fingerprint(t)) for i, t in corpus]
    label = brute.linked({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    want = by_repr((i, p, least.get(label[p])) for i, p in prints)
    got = by_repr((i, p & (1 << 64) - 1, c) for i, p, c in rows(simhash.classes(docs), "doc_id", "fp", "component_id"))
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert by_repr(i for i, in rows(kept, "doc_id")) == by_repr(i for i, p in prints if i is None or least[label[p]] == i)
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_lose_nothing(spark):
    import random

    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(20)] + [0]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    got = {frozenset(r) for r in simhash.links(spark.createDataFrame([(sign(x),) for x in prints], "fp long")).collect()}
    want = {frozenset((sign(a), sign(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(50, 90)] + [(1, 1), (2, 200), (200, 3), (300, 2), (300, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 50 for i in range(50, 91)}, 2: 2, 3: 2, 200: 2, 300: 2}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_hot_nodes(spark):
    """Stars whose middle is their smallest, largest or some other node, and pairs: few keys hold most edges."""
    stars = [(0, range(10, 3000)), (9000, range(4000, 6000)), (6500, [*range(6001, 6500), *range(6501, 7000)])]
    edges = [(m, x) for m, leaves in stars for x in leaves] + [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(1500)]
    got, plain = ({r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), spread=x).collect()} for x in (True, False))
    assert got == plain
    want = {x: min(m, *leaves) for m, leaves in stars for x in [m, *leaves]}
    assert got == {**want, **{20_000 + 2 * i + k: 20_000 + 2 * i for i in range(1500) for k in (0, 1)}}


def test_components_of_odd_graphs(spark):
    """Against a plain search: paths in any order, rings, trees, dense groups, loops, repeats, one edge."""
    import random

    rng = random.Random(21)
    name = rng.sample(range(-5000, 5000), 900)
    edges = [(name[i], name[i + 1]) for i in range(120)] + [(name[200 + i], name[200 + (i + 1) % 41]) for i in range(41)]
    edges += [(name[300 + i], name[300 + rng.randrange(i)]) for i in range(1, 200)] + [(name[600 + i], name[600 + j]) for i in range(25) for j in range(i)]
    edges += [(name[700 + rng.randrange(150)], name[700 + rng.randrange(150)]) for _ in range(90)] + [(name[890], name[890])]
    edges += edges[::3] + [(v, u) for u, v in edges[::5]]
    near, want = {}, {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for u in sorted(near):
        todo = [u]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = u
                todo += near[x]
    for cut in (edges, edges[:1]):
        for x in (True, False):
            got = components(spark.createDataFrame(cut, "u long, v long").repartition(3), len(name), spread=x).collect()
            assert len(got) == len({r.node for r in got})
            assert {r.node: r.component for r in got} == ({k: want[k] for k in want} if cut is edges else {k: min(edges[0]) for k in edges[0]})


def test_plans_of_simhash_stay_small(spark):
    """The driver keeps every plan. A chain of fingerprints takes several rounds; no plan of a round or of the result
    may hold a former step again and again."""
    chain, x = [], 0
    for i in range(40):
        x ^= 1 << (3 * i + 7) % 62 | 1 << (5 * i + 1) % 62
        chain.append((i, x))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    f, simhash.fingerprints = simhash.fingerprints, lambda docs, shingle: docs.selectExpr("doc_id", "cast(text as long) fp")
    try:
        got = simhash.classes(spark.createDataFrame([(i, str(p)) for i, p in chain], "doc_id long, text string"))
        assert {r.doc_id: r.component_id for r in got.collect()} == {i: 0 for i, _ in chain}
    finally:
        simhash.fingerprints = f
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = store.executionsList(before, 10_000)
    plans = [seen.apply(i).physicalPlanDescription() for i in range(seen.size())]
    sizes = [len(set(re.findall(r"^\(\d+\) .*(?:Exchange|Join|Aggregate).*$", p, re.M))) for p in plans]
    print(sizes)
    assert len(sizes) > 8 and max(sizes) <= 20


def test_oracles(spark):
    for m, f in ((phrases, phrases.op1_substring_dedup), (suffixes, suffixes.op2_suffix_array_dedup), (decontaminate, decontaminate.op4_benchmark_decontamination), (lines, lines.op9_line_dedup)):
        assert_equal(f(spark, SF), m.ORACLE)
    assert_equal(rules.quality_base_figures(spark, SF), rules.BASE_ORACLE)


def test_row_order_does_not_matter(docs):
    other = docs.orderBy(F.rand(1))
    assert rows(phrases.dedup_phrases(other), *P) == rows(phrases.dedup_phrases(docs), *P)


def shingles(text, n=5):
    w = brute.SPACE.findall(brute.lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def family(rng, n, words=150):
    """A text and near copies, each with two words replaced."""
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = [base]
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(words), 2):
            copy[at] = f"new{k}x{at}"
        out.append(copy)
    return [" ".join(x) for x in out]


def test_similar(spark):
    import random

    rng = random.Random(4)
    texts = [t for n in (1, 2, 5, 30) for t in family(rng, n)] + [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 200))) for _ in range(30)]
    texts += [texts[0].upper(), texts[3], "", " ", None, "short", "short", "Short"]
    rng.shuffle(texts)
    spread = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, node int, class_id int").repartition(3)
    label = {}
    for i in range(len(texts)):
        stack = [i]
        while stack:
            at = stack.pop()
            if at not in label:
                label[at] = label.get(i, i) if at != i else i
                stack += [j for j in range(len(texts)) if j not in label and alike(texts[at], texts[j])]
    got = {r.doc_id: r.class_id for r in similar.classes(spread).collect()}
    assert got == label
    kept = similar.keep_one(spread)
    assert kept.columns == spread.columns and {r.doc_id for r in kept.collect()} == set(label.values())


def test_similar_edge_cases(docs, corpus, empty):
    out = similar.keep_one(docs)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 2
    assert out.where("doc_id between 100 and 105").count() == 0 and out.where("doc_id in (500, 501, 502, 503)").count() == 2
    assert similar.classes(docs).count() == len(corpus) and similar.keep_one(empty).count() == 0


def test_forest_connects_what_pairs_connect():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64)
    sig = np.repeat(base, 40, 0)
    for k in range(40):
        for b in rng.integers(0, 256, 9):
            sig[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    a, b, star = similar._forest(sig, np.arange(40), None)
    assert (~star).sum() == 39 == similar.spanning(a, b, similar._far(sig, a, b)).sum()
    assert set(a.tolist()) | set(b.tolist()) == set(range(40)) and len(a) <= 78 and (similar._far(sig, a, b) <= similar.DISTANCE).all()


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for t in texts]
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


def found_classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.class_id for r in similar.classes(docs).collect()}


def test_similar_in_large_groups(spark):
    """Orders of the same words have one signature and few common shingles; each has one copy near 0.8."""
    import random

    rng = random.Random(8)
    words, texts = [f"w{i}" for i in range(100)], []
    for k in range(150):
        rng.shuffle(words)
        copy = list(words)
        for at in (20, 60):
            copy[at] = f"new{k}x{at}"
        texts += [" ".join(words), " ".join(copy)]
    rng.shuffle(texts)
    want = brute_classes(texts)
    assert len(set(want.values())) == 150 and found_classes(spark, texts) == want


def test_similar_with_passages_in_one_place(spark):
    """Every pair of at least 0.8 is found, if a passage is added, cut or replaced in one place."""
    import random

    rng = random.Random(15)
    texts = []
    for k in range(240):
        n = (100, 400)[k // 3 % 2]
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        share = rng.randrange(4, 20) * n // 100
        new = [f"w{rng.randrange(5000)}" for _ in range(share)]
        at = rng.randrange(n - share)
        other = (words + new, words[:at] + words[at + share :], words[:at] + new[: share // 2] + words[at + share // 2 :])[k % 3]
        texts += [" ".join(words), " ".join(other)]
    pairs = [i for i in range(0, len(texts), 2) if alike(texts[i], texts[i + 1])]
    got = found_classes(spark, texts)
    missed = [i for i in pairs if got[i] != got[i + 1]]
    print(f"{len(pairs) - len(missed)} of {len(pairs)} pairs found")
    assert len(pairs) > 150 and not missed
    assert got == brute_classes(texts)
