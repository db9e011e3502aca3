import random

import pytest
from holdfast.operators import dedup, keyed, links, reports, scan, sparse
from holdfast.operators import transitions as tr
from holdfast.operators.offsets import with_offsets
from holdfast.operators.predicates import archivable, sparsify_candidate
from holdfast.plans import start
from holdfast.schema import CATALOG, PHASES, bit, conform, unknown_labels
from pyspark.sql import functions as F


def catalog(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = {f.name: f.dataType.simpleString() for f in CATALOG}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
    return conform(df)


@pytest.mark.parametrize(
    "data, page, zero, saved",
    [
        (bytes(8192) + bytes(100), 4096, 2, 8292),
        (b"\x01" * 512, 4096, 0, 0),
        ((bytes(4095) + b"\x01") * 4, 4096, 0, 0),
        ((bytes(4095) + b"\x01") * 4, 2048, 4, 8192),
        ((bytes(4095) + b"\x01") * 4, 1024, 12, 12288),
        (b"\x01" * 4096 + bytes(8192) + b"\x02" * 4096, 4096, 2, 8192),
        (b"", 4096, 0, 0),
    ],
)
def test_zero_pages(data, page, zero, saved):
    for step in (1 << 20, 1000, 7):
        got = sparse.inspect([data[i : i + step] for i in range(0, len(data), step)], page)
        assert got[1:] == (len(data), zero, saved)


def test_page_must_hold_a_byte():
    with pytest.raises(ValueError):
        sparse.inspect([b"x"], 0)


def test_dirty_pages_count():
    data = bytearray(1 << 20)
    for k in range(2, 2002, 10):
        data[k * 512] = 1
    assert sparse.inspect([bytes(data)], 512)[2] == 2048 - 200


def test_sparse_copy(tmp_path):
    data = b"\x01" * 4096 + bytes(8192) + b"\x02" * 4096 + bytes(10)
    (tmp_path / "a").write_bytes(data)
    stats = sparse.sparse_copy(str(tmp_path / "a"), str(tmp_path / "b"))
    assert (stats.zero_blocks, stats.bytes_saved, stats.size_in) == (2, 8202, len(data))
    assert (tmp_path / "b").read_bytes() == data


def test_null_and_missing_content(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, bytearray(b""))], "id long, content binary")
    assert [(r.id, r.size) for r in sparse.inspect_content(df).orderBy("id").collect()] == [(1, None), (2, 0)]
    lost = spark.createDataFrame([(1, str(tmp_path / "none"))], "id long, path string")
    assert sparse.inspect_paths(lost).first().error


def test_predicates_part_all_rows(spark):
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [{"id": i, "rel_path": str(i), "size": 1, "sha1": pick(None, "a"), "ftype": pick(None, "file", "dir"), "canonical_id": pick(None, i, i + 1), "sparse_count": pick(None, 0, 5), "flags": pick(0, 4), "phase": "deduped"} for i in range(300)]
    files = catalog(spark, rows)
    for p in (sparsify_candidate(2), archivable(), archivable(False)):
        assert files.where(p).count() + files.where(~p).count() == 300


def simulate(rows, fail, fail_fast):
    """The rounds, group by group, in plain Python."""
    out, groups = {}, {}
    for i, key, content in rows:
        groups.setdefault(key, []).append((i, content))
    for members in groups.values():
        waiting, error = dict(sorted(members)), set()
        while waiting:
            free = [i for i in waiting if i not in error]
            if not free:
                out.update({i: (None, i in error) for i in waiting})
                break
            canon = min(free)
            settled, marks = [], set()
            for i in waiting:
                if i == canon or (fail_fast and i in error):
                    continue
                if (canon, i) in fail:
                    marks.add(fail[canon, i])
                elif waiting[i] == waiting[canon]:
                    settled.append(i)
            error |= marks
            for i in [*settled, canon]:
                out[i] = (canon, i in error)
                del waiting[i]
    return out


@pytest.mark.parametrize("fail_fast", [False, True])
def test_rounds_with_errors(spark, fail_fast):
    rng = random.Random(3)
    rows = [(i, i % 4, rng.choice("abc")) for i in range(40)]
    fail = {(a, b): rng.choice((a, b)) for a in range(40) for b in range(40) if a < b and a % 4 == b % 4 and rng.random() < 0.15}
    df = spark.createDataFrame([(i, str(k), 1, c) for i, k, c in rows], "id long, sha1 string, size long, content string")
    failing = spark.createDataFrame([(a, b, s) for (a, b), s in fail.items()], "canonical long, candidate long, side long")
    got = {r.id: (r.canonical_id, r.error) for r in dedup.elect_with_errors(df, failing, fail_fast).collect()}
    assert got == simulate(rows, fail, fail_fast)


def test_elect_handles_null_keys_and_hot_groups(spark):
    rows = [(i, None if i == 7 else "x", 0) for i in range(50)]
    got = {r.id: r.canonical_id for r in dedup.elect(spark.createDataFrame(rows, "id long, sha1 string, size long")).collect()}
    assert got == {i: 7 if i == 7 else 0 for i in range(50)}


def test_singletons_may_stay_without_canonical(spark):
    files = catalog(spark, [{"id": i, "rel_path": str(i), "size": 1, "sha1": s, "ftype": "file", "phase": "filtered"} for i, s in enumerate("aab")])
    strict = {r.id: r.canonical_id for r in dedup.dedup(files, singletons_canonical=False).collect()}
    assert strict == {0: 0, 1: 0, 2: None}
    assert {r.id: r.canonical_id for r in dedup.dedup(files).collect()} == {0: 0, 1: 0, 2: 2}


def test_snapshot_promotes_copies_too(spark):
    files = catalog(spark, [{"id": 1, "rel_path": "canonical.txt", "size": 10, "ftype": "file", "canonical_id": 1, "phase": "archived", "flags": bit("extracted") | bit("appended")}, {"id": 2, "rel_path": "duplicate.txt", "size": 10, "ftype": "file", "canonical_id": 1, "phase": "archived"}])
    snapshot = spark.createDataFrame([("canonical.txt", "archived")], "rel_path string, phase string")
    after, direct = tr.confirm_snapshot(files, snapshot)
    assert [r.phase for r in after.collect()] == ["unarchived"] * 2 and direct.count() == 1
    counts = reports.extraction_counts(files).first()
    assert (counts.missing, counts.extracted_canonical, counts.extracted_paths, counts.unconfirmed) == (0, 1, 2, 2)
    assert reports.extraction_counts(tr.normalise_installed(files)).first().missing == 1


def test_offsets_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 13).alias("size"), (-F.col("id")).alias("k"))
    total = 0
    for n, r in enumerate(sorted(with_offsets(df, ["k"]).collect(), key=lambda r: r.k)):
        assert (r.position, r.offset) == (n + 1, total)
        total += r["size"]
    assert with_offsets(df.limit(0), ["k"]).count() == 0


def test_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(40, None), (50, 51), (51, 50), (60, 99), (70, 70), (80, 50)]
    got = {r.node: (r["last"], r.hops, r.kind) for r in links.resolve_links(spark.createDataFrame(chain, "node long, target long")).collect()}
    assert all(got[i] == (40, 40 - i, "end") for i in range(41))
    assert got[60] == (99, 1, "dangling")
    assert all(got[i] == (None, None, "cycle") for i in (50, 51, 70, 80))


def test_link_types(spark):
    files = catalog(spark, [{"id": 1, "rel_path": "a", "size": 0, "ftype": "file"}, {"id": 2, "rel_path": "l", "size": 0, "ftype": "symlink_unknown", "link_dst": "a"}, {"id": 3, "rel_path": "m", "size": 0, "ftype": "symlink_unknown", "link_dst": "z"}])
    resolved = links.resolve_links(files.select(F.col("rel_path").alias("node"), F.col("link_dst").alias("target")))
    assert {r.rel_path: r.ftype for r in links.link_types(files, resolved).collect()} == {"a": "file", "l": "symlink_file", "m": "symlink_dangling"}


def test_sessions(spark):
    files = catalog(spark, [{"id": 1, "rel_path": "a", "size": 1, "flags": bit("appended"), "phase": "staged"}])
    s = spark.createDataFrame([], "id long, archive_offset long, finalized int, started_at timestamp, finished_at timestamp")
    s = keyed.finalize_session(keyed.begin_session(s, 0), 1)
    assert reports.has_finalized_session(s)
    s, files, offset = keyed.recover(keyed.begin_session(s, 77), files)
    assert offset == 77 and files.first().flags == 0 and {r.id: r.finalized for r in s.collect()} == {1: 1, 2: 2}
    assert keyed.recover(s, files)[2] is None


def test_meta(spark):
    m = spark.createDataFrame([("a", "1")], "key string, value string")
    m = keyed.upsert(m, spark.createDataFrame([("a", "2"), ("b", "3")], "key string, value string"))
    assert keyed.meta_value(m, "a") == "2" and keyed.meta_value(m, "z") is None


@pytest.mark.parametrize("policy, incomplete, finished, action", [("auto", True, True, "resume"), ("auto", False, True, "done"), ("auto", False, False, "fresh"), ("fresh", True, True, "fresh"), ("resume", True, False, "resume"), ("resume", False, True, None)])
def test_start(policy, incomplete, finished, action):
    if action is None:
        with pytest.raises(start.StartError):
            start.resolve(policy, incomplete, finished)
    else:
        assert start.resolve(policy, incomplete, finished) == action


def test_start_flags():
    assert [start.policy(*x) for x in ((False, False), (True, False), (False, True))] == ["auto", "resume", "fresh"]
    with pytest.raises(start.StartError):
        start.policy(True, True)


def test_scan_state():
    a = scan.ScanState(saw_manifest=True, saw_any=True, last_index=5, snapshots=1)
    b = a.merge(scan.ScanState(last_index=3, from_footer=True))
    assert b.next_index() == 6 and b.saw_manifest and b.from_footer and scan.ScanState().next_index() == 0
    with pytest.raises(scan.ScanError):
        scan.outcome(scan.ScanState())
    assert scan.outcome(scan.ScanState(), resumed=True) == "resumed without provenance"
    assert scan.outcome(b) == "complete with footer"


def test_misplaced_members(spark):
    rows = spark.createDataFrame([(0, "snapshot.sqlite"), (1, "manifest.sqlite"), (2, "junk")], "member_index long, name string")
    assert [r.member_index for r in scan.misplaced(rows).orderBy("member_index").collect()] == [0, 1, 2]
    assert [r.member_index for r in scan.misplaced(rows, force=True).orderBy("member_index").collect()] == [1, 2]


def test_labels(spark):
    files = catalog(spark, [{"id": i, "rel_path": str(i), "size": 1, "phase": p} for i, p in enumerate([*PHASES, "odd"])])
    assert [r.phase for r in unknown_labels(files).collect()] == ["odd"]


def test_lookup(spark, tmp_path):
    from holdfast.operators import lookup

    assert lookup.open_catalog(spark, str(tmp_path / "none")).count() == 0
    files = catalog(spark, [{"id": i, "rel_path": str(i), "size": 1, "phase": "staged" if i % 2 else "hashed"} for i in (3, 1, 2)])
    assert lookup.by_id(files, 2).count() == 1 and lookup.count(files) == 3 and lookup.count(files, "staged") == 2
    assert [r.id for r in lookup.in_order(files, "staged").collect()] == [1, 3] and len(lookup.in_order(files, "staged").columns) == 12
