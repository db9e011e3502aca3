import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from holdfast.llm import langid, quality, rules
from holdfast.llm.textcore import texts
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_base_rules(docs, corpus, empty):
    got = sorted((tuple(r)[:7] for r in rules.rules(docs, np.zeros(rules.BUCKETS, np.float32)).collect()), key=repr)
    assert got == sorted(((i, *brute.base_rules(t)) for i, t in corpus), key=repr)
    assert rules.rules(empty, np.zeros(rules.BUCKETS, np.float32)).count() == 0


def test_ratio_is_the_multinomials(spark):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, "bbbb"), (3, None), (4, "aaaa b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    ratio = rules.learn(docs, labels)
    data = np.frombuffer(b"aaa", np.uint8)
    words = (np.array([0]), np.array([3]), np.array([0, 1]), np.array([1], np.uint64))
    bucket = rules.grams(data, np.array([0, 3]), words)[0][0]
    t = (2 + rules.ALPHA) / (4 + rules.ALPHA * rules.GRAMS)
    r = (4 + rules.ALPHA) / (10 + rules.ALPHA * rules.GRAMS)
    assert ratio[bucket] == pytest.approx(np.log(t / r), abs=1e-5)
    assert not rules.learn(docs, labels.limit(0)).any()


def test_every_trusted_document_counts(spark):
    n = 20_100
    docs = spark.range(n).selectExpr("id doc_id", "if(id % 2 = 0, 'aaa', 'bbb') text").unionByName(spark.createDataFrame([(None, "aaa")] * 5, "doc_id long, text string"))
    ratio = rules.learn(docs, spark.range(n).selectExpr("id doc_id", "1 quality"))
    words = (np.array([0]), np.array([3]), np.array([0, 1]), np.array([1], np.uint64))
    bucket = rules.grams(np.frombuffer(b"aaa", np.uint8), np.array([0, 3]), words)[0][0]
    t = (n / 2 + rules.ALPHA) / (n + rules.ALPHA * rules.GRAMS)
    r = (n / 2 + 5 + rules.ALPHA) / (n + 5 + rules.ALPHA * rules.GRAMS)
    assert ratio[bucket] == pytest.approx(np.log(t / r), abs=1e-6)


def test_rules_on_the_tables(spark):
    docs, labels = texts(spark, DATA), texts(spark, DATA, "labels")
    found = rules.op3_quality_rules(spark, DATA).join(labels, "doc_id").where("not base_failed")
    assert found.where("quality = 1 and not kept").count() == 0
    assert found.where("quality = 0 and kept").count() <= 1
    kept = rules.keep_good(docs, rules.learn(docs, labels))
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def test_quality_on_the_tables(spark):
    labels = texts(spark, DATA, "labels")
    out = quality.op10_quality_classifier(spark, DATA).cache()
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out.collect())
    seen = out.join(labels, "doc_id").where("held_out")
    assert seen.where("predicted <> quality").count() <= 0.05 * seen.count()


def test_quality_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(empty, model).count() == 0
    assert quality.keep_good(docs, model).schema == docs.schema
    for only, value in ((labels.limit(0), 1.0), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        assert {r.score for r in quality.scored(docs, quality.train(docs, only)).collect()} == {value}
    assert {r.score for r in quality.scored(empty, quality.train(empty, labels)).collect()} == set()


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 200)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 6) + 50 * y, rng.integers(100, 400, 6)])) for y in label]
    model = quality.fit(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), label)
    margin = [model["v"][r].sum() / np.sqrt(model["r2"][r].sum()) + model["b"] for r in rows]
    assert ((np.array(margin) > 0) == (label == 1)).mean() > 0.97 and model["scale"] > 0


def test_the_fit_minimises_the_hinge_loss():
    """No step from the fitted weights lowers the regularised, class-weighted squared hinge loss."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 120)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 5) + 25 * y, rng.integers(100, 160, 5)])) for y in label]
    model = quality.fit(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), label, rounds=300)
    ratio = np.sqrt(model["r2"].astype(float)) * np.sign(model["r2"])
    again, held = np.random.default_rng(quality.SEED), np.zeros(len(label), bool)
    for c in (0, 1):
        own = again.permutation(np.flatnonzero(label == c))
        held[own[: len(own) // 5]] = True
    used = sorted({i for r in rows for i in r.tolist()})
    x = np.zeros((len(rows), len(used)))
    for k, r in enumerate(rows):  # signs of ratios only turn weights over, so they are left out on both sides
        x[k, np.searchsorted(used, r)] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    w = model["v"][used].astype(float) / np.where(ratio[used] > 0, ratio[used], 1)
    y, n, ones = 2.0 * label - 1, len(label), int(label.sum())
    weight = np.where(label == 1, n / (2 * ones), n / (2 * (n - ones)))

    def loss(w, b):
        slack = np.maximum(0, 1 - y * (x @ w + b))[~held]
        return 0.5 * (w @ w + b * b) + (weight[~held] * slack**2).sum()

    best = loss(w, model["b"])
    for _ in range(200):
        d, e = rng.normal(size=len(used)) * 0.02, rng.normal() * 0.02
        assert loss(w + d, model["b"] + e) > best


def plain_features(text):
    """Distinct features of a text, built word by word: as sets of names, not of buckets."""
    words = brute.SPACE.findall(text)
    shape = [re.sub(r"([A-Z])+|([a-z\x80-\U0010ffff])+|([0-9])+", lambda m: "A" if m[1] else "a" if m[2] else "0", w) for w in words]
    out = {("word", w) for w in words} | {("pair", a, b) for a, b in zip(words, words[1:])}
    pairs = [(a, b, c == d) for a, b, c, d in zip(shape, shape[1:], words, words[1:])]
    for kind, names in (("shape", shape), ("shapes", pairs)):
        out |= {(kind, k, math.ceil(math.log2(n / len(words)) * 0.75)) for k, n in Counter(names).items()}
    return out


def test_features_against_plain_version():
    """As many buckets as plain features (but for collisions), and equal ones exactly where names are equal."""
    rng, bucket = random.Random(9), {}
    texts_ = [" ".join(rng.choice(["Ab", "ab", "a1", "99", "x-y", "\u00e9t\u00e9", "AB", "Q"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    data = np.frombuffer("".join(texts_).encode(), np.uint8)
    index, offs = quality.features(data, np.cumsum([0, *(len(t.encode()) for t in texts_)]))
    sets = [set(index[offs[i] : offs[i + 1]].tolist()) for i in range(len(texts_))]
    names = [plain_features(t) for t in texts_]
    assert sum(len(a) != len(b) for a, b in zip(sets, names)) <= 2
    for i in range(len(texts_)):
        for j in range(i):
            assert abs(len(sets[i] & sets[j]) - len(names[i] & names[j])) <= 1


def test_order_of_the_sample_does_not_matter(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(docs.orderBy(F.rand(3)), labels.orderBy(F.rand(4)))
    assert (a["v"] == b["v"]).all() and a["shift"] == b["shift"]


def test_languages_on_the_tables(spark):
    out = langid.op5_language_id(spark, DATA).cache()
    assert out.count() == 1000 and out.where("score < 0 or score > 1").count() == 0
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in out.collect())
    held = out.join(texts(spark, DATA).select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang <> lang_pred").count() <= 0.01 * held.count()


def test_mixtures_and_undetermined(spark):
    rows = texts(spark, DATA).where("lang in ('en', 'de')").limit(300).collect()
    en, de = [next(r.text for r in rows if r.lang == k and 1500 < len(r.text) < 4000) for k in ("en", "de")]
    model = langid.learn(spark.createDataFrame(rows).select("text", "lang"))
    docs = spark.createDataFrame([(1, en + " " + de), (2, None), (3, ""), (4, "123 !? 4"), (5, "日本"), (6, en), (6, en), (None, de)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert set(got[1].languages) == {"en", "de"} and sum(got[1].languages.values()) == pytest.approx(1, abs=1e-3)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))
    assert got[5].lang_pred in ("en", "de") and got[6].lang_pred == "en" and got[None].lang_pred == "de"


def test_nothing_learned(spark, docs, empty):
    model = langid.learn(docs.where("doc_id = 500"))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_any_number_of_languages(spark):
    many = spark.createDataFrame([(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 3, f"l{i}") for i in range(300)], "text string, lang string")
    model = langid.learn(many)
    assert len(model["langs"]) == 300
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 9) for i in range(0, 300, 7)], "doc_id long, text string")
    assert all(r.lang_pred == f"l{r.doc_id}" for r in langid.predict(docs, model).collect())


ALPHABETS = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "012yz3", "456789\u00e4"]


def spoken(rng, k, n):
    return " ".join("".join(rng.choice(ALPHABETS[k]) for _ in range(5)) + "\u00e9" for _ in range(n))


def test_sets_of_more_than_four_languages(spark):
    rng = random.Random(5)
    model = langid.learn(spark.createDataFrame([(spoken(rng, k, 2000), f"l{k}") for k in range(6)], "text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, " ".join(spoken(rng, k, 60) for k in range(6)))], "doc_id long, text string"), model).first()
    assert set(got.languages) == {f"l{k}" for k in range(6)} and all(v == pytest.approx(1 / 6, abs=0.02) for v in got.languages.values())


def plain_mixture(text, model):
    """The same inference word by word and set by set, without pruning; proportions of the best set."""
    log, k = model["log"].astype(float), len(model["langs"])
    like = []
    for w in text.encode().lower().split():
        data, offs = np.frombuffer(w, np.uint8), np.array([0, len(w)])
        bucket, _, which, _, n = langid.words_of(data, offs)
        if n:
            v = log[:, bucket].sum(1)
            like.append(np.maximum(np.exp(v - v.max()), 1e-30))
    like = np.array(like)

    def em(theta, rounds):
        for _ in range(rounds):
            r = like * theta
            theta = (r / r.sum(1, keepdims=True)).mean(0)
        return theta

    theta = em(np.full(k, 1 / k), langid.ROUNDS)
    best = (-np.inf, None)
    for size in range(1, k + 1):
        part = np.zeros(k)
        own = np.argsort(-theta, kind="stable")[:size]
        part[own] = np.maximum(theta[own], 1e-6)
        part /= part.sum()
        part = em(part, langid.SET_ROUNDS) if size > 1 else part
        value = np.log(np.maximum(like @ part, 1e-37)).sum() - langid.PENALTY * size * np.log(max(len(like), 2))
        best = max(best, (value, part.tolist()), key=lambda x: x[0])
    return best[1]


def test_inference_against_plain_version(spark):
    rng = random.Random(6)
    model = langid.learn(spark.createDataFrame([(spoken(rng, k, 300), f"l{k}") for k in range(6)], "text string, lang string"))
    texts_ = [" ".join(spoken(rng, k, rng.randint(1, 40)) for k in rng.sample(range(6), rng.randint(1, 6))) for _ in range(30)]
    data = np.frombuffer("".join(texts_).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts_)])
    for share, text in zip(langid.infer(model, data, offs), texts_):
        assert share == pytest.approx(plain_mixture(text, model), abs=2e-3)


def test_features_are_distinct_and_ordered():
    index, offs = quality.features(np.frombuffer("A b A b".encode(), np.uint8), np.array([0, 0, 7]))
    assert offs[0] == offs[1] == 0 and (np.diff(index) > 0).all() and len(index) == offs[2]
    assert pa.array(index).null_count == 0
