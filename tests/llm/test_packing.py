import zlib

import corpus_pipeline
import numpy as np
import pytest
from holdfast.llm import packing, queries

from oracle import SF


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary()[1])
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_tokenizer(tokenizer):
    encode = packing.Encoder(*packing.vocabulary())
    for t in ["", "<|endoftext|> a", "  \u0085 x \n\n\ty", "é" * 50, "\U0001f600 \x00\x1c z", "a" * 5000, " " * 300 + "b", "٣٤ ⅷ ²", "it's we'll I'D"]:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [packing.PARTITIONS, 1])
def test_round_trip(spark, docs, corpus, empty, tokenizer, monkeypatch, most):
    monkeypatch.setattr(packing, "PARTITIONS", most)  # one partition: several groups of two rounds' rows
    monkeypatch.setattr(packing, "GROUP", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    out = packing.pack(packing.pieces(docs), group=20).collect()
    want = []
    for i, t in corpus:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_few_sequences(spark):
    out = packing.op6_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    assert len({r.sequence_id for r in out}) <= 1.02 * np.ceil(sum(r.length for r in out) / 1024)


def plain_best_fit(lengths, tokens, documents, attention, weights, rule):
    """Every open bin is asked for every piece; the bins as (tokens, pieces, cost) used."""
    cap, bins = (tokens, documents, attention), []
    for n in sorted(lengths, reverse=True):
        need, best = (n, 1, n * n), None
        for k, used in enumerate(bins):
            left = [c - u for c, u in zip(cap, used)]
            if all(x >= y for x, y in zip(left, need)):
                if rule == "norm":
                    cost = sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, left, need, cap))
                else:
                    cost = -sum(w * y / c**2 * x for w, x, y, c in zip(weights, left, need, cap))
                if best is None or cost < best[0]:
                    best = cost, k
        if best is None or n == tokens:
            bins.append(list(need))
        else:
            bins[best[1]] = [u + y for u, y in zip(bins[best[1]], need)]
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(1024, 1 << 20), (3, 1 << 20), (1024, 60_000), (4, 80_000)])
def test_best_fit_against_plain_version(rule, documents, attention):
    rng = np.random.default_rng(documents + attention)
    for weights in ((1.0, 1e-3, 1e-3), (0.7, 0.31, 0.53)):
        lengths = rng.integers(1, 230, 160)
        where, _ = packing.best_fit(lengths, 256, documents, attention, weights, rule)
        got = sorted((int(lengths[where == b].sum()), int((where == b).sum()), int((lengths[where == b] ** 2).sum())) for b in set(where.tolist()))
        assert got == plain_best_fit(lengths.tolist(), 256, documents, attention, weights, rule)


def test_capacities_that_bind(spark):
    """The query's operator on the table, with fewer documents and less attention than the tokens allow."""
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 512).cache()
    counts = []
    for documents, attention in ((1024, 1 << 20), (2, 1 << 20), (1024, 400_000)):
        bins = {}
        for r in packing.pack(parts, 1024, documents, attention).collect():
            bins.setdefault(r.sequence_id, []).append(r.length)
        assert all(sum(b) <= 1024 and len(b) <= documents and sum(n * n for n in b) <= attention for b in bins.values())
        counts.append(len(bins))
    assert counts[0] < min(counts[1:])


def test_pieces_beyond_a_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]))


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_odd_rows(spark, docs, empty, corpus):
    """Nulls, repeated rows and ids, empty texts and clashing columns pass through every stage; empty stays empty."""
    now, ids = docs, {i for i, _ in corpus}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and stage(spark, empty, SF).count() == 0
        now = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in now.select("doc_id").distinct().collect()} <= ids
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, now, SF).select("doc_id").distinct().count() == now.select("doc_id").distinct().count() and last(spark, empty, SF).count() == 0


def test_the_pipeline_leaves_no_tables(spark):
    from pathlib import Path

    folder = Path(packing.shared_dir(spark).removeprefix("file:"))
    corpus_pipeline.run(spark, SF).count()
    assert not [p for p in folder.glob("pipeline-*")]


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
