import lzma
import os

import pytest
from holdfast.plans import runner
from holdfast.sources import archive as ar
from holdfast.sources import tree
from holdfast.streaming.ingest import EVENTS, Ingest
from pyspark.sql import functions as F


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "root"
    (r / "sub" / "deep").mkdir(parents=True)
    (r / "empty").mkdir()
    (r / "a.txt").write_bytes(b"same")
    (r / "sub" / "b.txt").write_bytes(b"same")
    (r / "sub" / "noext").write_bytes(b"other" * 1000)
    (r / "sub" / ".hidden").write_bytes(b"")
    (r / "sub" / "deep" / "zeros.bin").write_bytes(b"\x01" * 4096 + bytes(4096 * 5) + b"end")
    os.symlink("a.txt", r / "link")
    os.symlink("gone", r / "dangling")
    os.symlink("loop", r / "loop")
    os.mkfifo(r / "pipe")
    return str(r)


def content(root):
    out = {}
    for d, _, names in os.walk(root):
        for n in names:
            p = os.path.join(d, n)
            if os.path.isfile(p) and not os.path.islink(p):
                with open(p, "rb") as f:
                    out[os.path.relpath(p, root)] = f.read()
    return out


def test_tree(spark, root):
    rows = {r.rel_path: r for r in tree.read_tree(spark, root).collect()}
    assert {p: r.ftype for p, r in rows.items()} == {"": "dir", "a.txt": "file", "dangling": "symlink_dangling", "empty": "dir", "link": "symlink_file", "loop": "symlink_cycle", "pipe": "fifo", "sub": "dir", "sub/.hidden": "file", "sub/b.txt": "file", "sub/deep": "dir", "sub/deep/zeros.bin": "file", "sub/noext": "file"}
    assert rows["a.txt"].ext == ".txt" and rows["sub/.hidden"].ext == "" and rows["link"].link_dst == "a.txt"
    assert sorted(r.id for r in rows.values()) == list(range(1, 14))


@pytest.mark.parametrize("format, footer, pages", [("xz", True, 2), ("gzip", False, None)])
def test_round_trip(spark, root, tmp_path, format, footer, pages):
    path, out = str(tmp_path / "x.tar"), str(tmp_path / "out")
    o = runner.ArchiveOptions(root=root, archive=path, compression=format, level=1 if format != "none" else None, min_pages=pages, footer=footer)
    assert runner.archive(spark, o) == "done"
    names = [m["name"] for m in ar.read_members(path, content=False)]
    assert names[0] == "manifest.sqlite" and names[-1] == "snapshot.sqlite" and len(names) == 6
    assert sum(n.startswith("sp.") for n in names) == (1 if pages else 0)
    assert [r.member_index for r in ar.members_of(spark, path).orderBy("member_index").collect()] == list(range(6))
    notes = runner.extract(spark, runner.ExtractOptions(archive=path, output=out))
    assert notes == []
    assert content(out) == content(root)
    assert os.readlink(os.path.join(out, "link")) == "a.txt" and os.path.isdir(os.path.join(out, "empty"))
    assert runner.diff(runner.list_archive(spark, path), root).count() == 0
    if footer:
        assert runner.archive(spark, o) == "done"


def made(spark, root, tmp_path, **more):
    o = runner.ArchiveOptions(root=root, archive=str(tmp_path / "x.tar"), **{"compression": "none"} | more)
    notes = []
    return o, runner.archive(spark, o, None, notes), notes


def test_no_archive_is_replaced_unasked(spark, root, tmp_path):
    (tmp_path / "x.tar").write_bytes(b"something else")
    with pytest.raises(ValueError, match="exists"):
        made(spark, root, tmp_path)
    assert (tmp_path / "x.tar").read_bytes() == b"something else"
    assert made(spark, root, tmp_path, fresh=True, footer=False)[1] == "done"
    with pytest.raises(ValueError, match="exists"):
        made(spark, root, tmp_path, footer=False)


def test_equal_digests_are_compared(spark, root, tmp_path, monkeypatch):
    """With every digest alike and sizes equal, contents decide."""
    from holdfast.operators import sparse

    (tmp_path / "root" / "c.txt").write_bytes(b"diff")
    found = sparse.inspect_paths
    monkeypatch.setattr(runner.sp, "inspect_paths", lambda *a: found(*a).withColumn("sha1", F.lit("ab" * 20)))
    o, done, _ = made(spark, root, tmp_path, keep_work=True)
    rows = {r.rel_path: r for r in spark.read.parquet(o.archive + ".astage/catalog-archive-2").collect()}
    assert rows["sub/b.txt"].canonical_id == rows["a.txt"].id and rows["c.txt"].canonical_id == rows["c.txt"].id
    out = str(tmp_path / "out")
    runner.extract(spark, runner.ExtractOptions(archive=o.archive, output=out, rehash=False))
    assert content(out) == content(root)


def test_comparisons_that_fail(spark, root, tmp_path):
    from holdfast.operators import compare, dedup
    from holdfast.schema import conform

    rows = [(i, "ab", 4, "file", "filtered", p) for i, p in enumerate(["gone", "a.txt", "sub/b.txt", "gone2"], 1)]
    files = conform(spark.createDataFrame(rows, "id long, sha1 string, size long, ftype string, phase string, rel_path string"))
    paths = files.select("id", F.concat(F.lit(root + "/"), "rel_path").alias("path"))
    for fail_fast in (False, True):
        got = {r.id: (r.canonical_id, r.flags, r.phase) for r in dedup.dedup_files(files, paths, compare.compare_files, fail_fast).collect()}
        assert got[2] == (2, 0, "deduped") and got[3] == (2, 0, "deduped")
        assert got[4] == (None, 16, "deduped") and got[1][1:] == (16, "deduped")


def test_a_member_that_is_gone(spark, root, tmp_path):
    o, done, _ = made(spark, root, tmp_path, stop_after="stage")
    os.remove(os.path.join(root, "sub", "noext"))
    os.utime(os.path.join(root, "a.txt"), (1, 1))
    notes = []
    assert done == "stage" and runner.archive(spark, runner.ArchiveOptions(root=root, archive=o.archive, compression="none", keep_work=True), None, notes) == "done"
    assert any("gone" in n and "sub/noext" in n for n in notes) and any("changed since" in n and "a.txt" in n for n in notes)
    assert any("no whole payload" in n for n in notes)
    rows = {r.rel_path: r.flags for r in runner.list_archive(spark, o.archive).collect()}
    assert rows["sub/noext"] & 128 and not rows["sub/noext"] & 64 and rows["a.txt"] & 64
    out = str(tmp_path / "out")
    notes = runner.extract(spark, runner.ExtractOptions(archive=o.archive, output=out))
    assert any("not restored" in n and "sub/noext" in n for n in notes) and content(out) == content(root)


def test_a_member_that_shrinks(tmp_path):
    class Short:
        def read(self, n):
            self.parts = getattr(self, "parts", [b"ab", b""])
            return self.parts.pop(0)

    w = ar.ArchiveWriter(str(tmp_path / "a"), "none")
    import tarfile

    info = tarfile.TarInfo("m")
    info.size = 5
    with pytest.raises(ar.MemberError):
        w._write(info, Short())
    w.add_bytes("n", b"x")
    w.close()
    assert [(m["name"], m["content"]) for m in ar.read_members(str(tmp_path / "a"))] == [("m", b"ab\0\0\0"), ("n", b"x")]


class After:
    """Asks for a stop at the n-th question."""

    forced = False

    def __init__(self, n):
        self.n = n

    @property
    def requested(self):
        self.n -= 1
        return self.n < 0


def test_sessions_of_a_stopped_archive(spark, root, tmp_path):
    o, done, _ = made(spark, root, tmp_path, stop_after="stage", keep_work=True)
    o.stop_after = None
    assert done == "stage" and runner.archive(spark, o, After(2)) == "archive"
    assert [m["name"] for m in ar.read_members(o.archive, content=False)][-1] == "snapshot.sqlite" and not ar.has_footer(o.archive)
    part = os.path.getsize(o.archive)
    with open(o.archive, "ab") as f:
        f.write(b"x")
    with pytest.raises(RuntimeError, match="bytes"):
        runner.archive(spark, o)
    os.truncate(o.archive, part)
    assert runner.archive(spark, o) == "done" and ar.has_footer(o.archive)
    names = [m["name"] for m in ar.read_members(o.archive, content=False)]
    assert names[0] == "manifest.sqlite" and names.count("snapshot.sqlite") == 2 and len(set(names)) == len(names) - 1
    sessions = spark.read.parquet(o.archive + ".astage/sessions-4").orderBy("id").collect()
    assert [(s.id, s.finalized) for s in sessions] == [(1, 1), (2, 1)] and sessions[1].archive_offset == part
    out = str(tmp_path / "out")
    assert runner.extract(spark, runner.ExtractOptions(archive=o.archive, output=out)) == [] and content(out) == content(root)


def test_a_session_that_was_not_ended(spark, root, tmp_path, monkeypatch):
    """A run that dies while it writes: its session is cut off and its members are written again."""
    o, _, _ = made(spark, root, tmp_path, stop_after="stage", keep_work=True)
    o.stop_after = None
    runner.archive(spark, o, After(2))
    part = os.path.getsize(o.archive)

    class Died(BaseException):
        pass

    def die(self, last=True):
        self.file.flush()
        raise Died

    with monkeypatch.context() as m:
        m.setattr(ar.ArchiveWriter, "close", die)
        m.setattr(ar.ArchiveWriter, "abandon", lambda self: self.file.close())
        m.setattr(runner.keyed, "abort_session", lambda sessions, number: sessions)
        with pytest.raises(Died):
            runner.archive(spark, o)
    assert os.path.getsize(o.archive) > part
    assert runner.archive(spark, o) == "done"
    out = str(tmp_path / "out")
    assert runner.extract(spark, runner.ExtractOptions(archive=o.archive, output=out)) == [] and content(out) == content(root)


def test_a_stopped_scan_goes_on(spark, root, tmp_path):
    o, _, _ = made(spark, root, tmp_path)
    out = str(tmp_path / "out")
    x = runner.ExtractOptions(archive=o.archive, output=out, keep_work=True)
    assert any("stopped in scan_tar" in n for n in runner.extract(spark, x, After(1)))
    before = {n: os.stat(os.path.join(out + ".estage", "cache", n)).st_mtime_ns for n in os.listdir(out + ".estage/cache")}
    assert len(before) == 1
    assert runner.extract(spark, x) == [] and content(out) == content(root)
    assert {n: os.stat(os.path.join(out + ".estage", "cache", n)).st_mtime_ns for n in before} == before
    names = sorted(n for n in os.listdir(out + ".estage") if n.startswith("members-"))
    assert names == ["members-0.parquet", "members-2.parquet"]


def test_a_payload_that_is_missing(spark, root, tmp_path):
    o, _, _ = made(spark, root, tmp_path)
    out = str(tmp_path / "out")
    x = runner.ExtractOptions(archive=o.archive, output=out, rehash=False, keep_work=True)
    stop = After(10**6)
    first = runner._EXTRACT["place"]

    def lose(run, files):
        cache = os.path.join(out + ".estage", "cache")
        os.remove(os.path.join(cache, sorted(os.listdir(cache))[0]))
        return first(run, files)

    runner._EXTRACT["place"] = lose
    try:
        with pytest.raises(ValueError, match="payload"):
            runner.extract(spark, x, stop)
    finally:
        runner._EXTRACT["place"] = first
    x.force = True
    assert any("payload" in n for n in runner.extract(spark, x)) and len(content(out)) < len(content(root))


def test_unreadable_files_are_said(spark, root, tmp_path, monkeypatch):
    found = runner.sp.inspect_paths
    monkeypatch.setattr(runner.sp, "inspect_paths", lambda *a: found(*a).withColumn("sha1", F.when(F.col("size") != 5000, F.col("sha1"))))
    o, _, notes = made(spark, root, tmp_path, retry_missing_sha=True)
    assert any("could not be read" in n and "sub/noext" in n for n in notes)
    monkeypatch.undo()
    notes = runner.extract(spark, runner.ExtractOptions(archive=o.archive, output=str(tmp_path / "out")))
    assert any("sub/noext" in n and "not restored" in n for n in notes)


def test_names_keeping_and_meta(spark, root, tmp_path, capsys):
    import grp
    import pwd

    from holdfast.__main__ import main

    o, _, _ = made(spark, root, tmp_path, keep_stage=True)
    assert not os.path.exists(o.archive + ".astage")
    s = os.stat(root)
    row = spark.read.parquet(ar.read_catalog(spark, _catalog(o.archive, tmp_path)).inputFiles()[0]).where("rel_path = 'a.txt'").first()
    assert (row.username, row.groupname) == (pwd.getpwuid(s.st_uid).pw_name, grp.getgrgid(s.st_gid).gr_name)
    assert main(["meta", "-f", o.archive]) == 0
    said = dict(x.split("\t") for x in capsys.readouterr().out.splitlines())
    assert said["root"] == root and said["written_at"].endswith("+00:00")
    out = str(tmp_path / "out")
    runner.extract(spark, runner.ExtractOptions(archive=o.archive, output=out, cache=str(tmp_path / "elsewhere"), keep_db=True))
    assert not os.path.exists(tmp_path / "elsewhere") and os.path.exists(out + ".estage/state.json")
    assert main(["sparse-copy", "-l", os.path.join(root, "sub", "deep", "zeros.bin"), str(tmp_path / "no")]) == 0
    assert "5 zero block" in capsys.readouterr().out and not os.path.exists(tmp_path / "no")


def _catalog(archive, tmp_path):
    path = str(tmp_path / "catalog.sqlite")
    ar.read_footer(archive, path)
    return path


@pytest.mark.parametrize("format", ["xz", "gzip", "bzip2", "zstd"])
def test_threads(tmp_path, format, monkeypatch):
    monkeypatch.setattr(ar, "BLOCK", 1000)
    p = str(tmp_path / "a")
    w = ar.ArchiveWriter(p, format, 1, threads=3)
    if isinstance(w.out, ar._Threaded):
        w.out.block = 1000
    data = os.urandom(20_000)
    w.add_bytes("m", data)
    w.close()
    assert [m["content"] for m in ar.read_members(p)] == [data]
    size = os.path.getsize(p)
    w = ar.ArchiveWriter(p, format, 1, threads=3)
    w.add_bytes("lost", data)
    w.abandon()
    assert os.path.getsize(p) == size


def test_memory_limit(tmp_path):
    with pytest.raises(ValueError):
        ar.ArchiveWriter(str(tmp_path / "a"), "xz", 9, threads=4, memory=1 << 20)
    w = ar.ArchiveWriter(str(tmp_path / "a"), "xz", 1, threads=8, memory=60 << 20)
    assert w.out.threads == 2
    w.abandon()


def test_stop_and_resume(spark, root, tmp_path):
    path = str(tmp_path / "x.tar.gz")
    o = runner.ArchiveOptions(root=root, archive=path, compression="gzip", stop_after="hash")
    assert runner.archive(spark, o) == "hash" and not os.path.exists(path)
    o.stop_after, o.resume = None, True
    assert runner.archive(spark, o) == "done" and ar.has_footer(path)


def test_filters(spark, root, tmp_path):
    path, out = str(tmp_path / "x.tar"), str(tmp_path / "out")
    runner.archive(spark, runner.ArchiveOptions(root=root, archive=path, compression="none", exclude=["*.bin"]))
    runner.extract(spark, runner.ExtractOptions(archive=path, output=out))
    assert set(content(root)) - set(content(out)) == {"sub/deep/zeros.bin"}


def test_damaged_payload_is_noted(spark, root, tmp_path):
    path, out = str(tmp_path / "x.tar"), str(tmp_path / "out")
    runner.archive(spark, runner.ArchiveOptions(root=root, archive=path, compression="none"))
    with open(path, "r+b") as f:
        data = f.read()
        at = data.index(b"otherother")
        f.seek(at)
        f.write(b"XXXX")
    assert any("differ" in n for n in runner.extract(spark, runner.ExtractOptions(archive=path, output=out)))


def test_footer_failures(tmp_path):
    p, db = str(tmp_path / "a"), str(tmp_path / "db")
    with open(db, "wb") as f:
        f.write(b"catalog")
    with open(p, "wb") as f:
        f.write(b"x" * 100)
    ar.write_footer(p, db)
    assert ar.read_footer(p) == b"catalog" and ar.footer_offset(p) == 100
    good = open(p, "rb").read()
    m = len(ar.MAGIC)
    bad = {
        "small": good[:20],
        "offset": good[:-8] + (10**9).to_bytes(8, "little"),
        "magic": good[:-8] + (1).to_bytes(8, "little"),
        "damaged": good[: 100 + m] + b"C" + good[101 + m :],
        "end": good[: -8 - m] + b"?" + good[-7 - m :],
    }
    for data in bad.values():
        with open(p, "wb") as f:
            f.write(data)
        with pytest.raises(ar.FooterError):
            ar.read_footer(p)
        assert not ar.has_footer(p)


def test_sessions_concatenate(tmp_path):
    p = str(tmp_path / "a.tar.xz")
    for k, last in ((0, False), (1, False), (2, True)):
        w = ar.ArchiveWriter(p, "xz", 0)
        w.add_bytes(f"m{k}", b"z" * (700 * k))
        w.close(last)
    size = os.path.getsize(p)
    w = ar.ArchiveWriter(p, "xz", 0)
    w.add_bytes("lost", b"z")
    w.abandon()
    assert os.path.getsize(p) == size
    assert [(m["name"], m["size"]) for m in ar.read_members(p)] == [("m0", 0), ("m1", 700), ("m2", 1400)]
    assert [m["name"] for m in ar.read_members(p, start=2)] == ["m2"]
    with lzma.open(p) as f:
        assert len(f.read()) % 512 == 0


@pytest.mark.parametrize("format", ["xz", "gzip", "bzip2", "zstd", "none"])
def test_formats(tmp_path, format):
    p, db = str(tmp_path / "a"), tmp_path / "db"
    db.write_bytes(b"catalog")
    for last in (False, True):
        w = ar.ArchiveWriter(p, format, 1 if format != "none" else None)
        w.add_bytes(f"m{last}", b"data" * 300)
        w.close(last)
    ar.write_footer(p, str(db))
    assert ar.compression_of(p) == format
    assert [(m["name"], m["content"]) for m in ar.read_members(p)] == [("mFalse", b"data" * 300), ("mTrue", b"data" * 300)]


def test_levels_and_threads():
    assert ar.level_of("zstd", None) == 19 and ar.fitting_threads(8, 100, 30) == 3 and ar.fitting_threads(8, None, 30) == 8
    with pytest.raises(ValueError):
        ar.level_of("gzip", 0)
    with pytest.raises(ValueError):
        ar.fitting_threads(2, 10, 30)


def test_unsafe_paths_are_refused(spark, root, tmp_path):
    from holdfast.operators import transitions as tr
    from holdfast.operators.restore import restore_plan
    from pyspark.sql import functions as F

    files = tree.read_tree(spark, root)
    files = tr.update(files, F.col("ftype") == "file", canonical_id=F.col("id"), sha1="00" * 20, phase="unarchived", rel_path=F.concat(F.lit("../"), F.col("rel_path")))
    assert restore_plan(files).where("safe").count() == 0


def test_stream(spark, tmp_path):
    from holdfast.functions.content import content_id
    from holdfast.schema import conform

    files = conform(spark.createDataFrame([(i, f"p{i}", 1, "ab" * 20, "file", 1 if i == 2 else i, "archived") for i in range(1, 6)], "id long, rel_path string, size long, sha1 string, ftype string, canonical_id long, phase string"))
    names = {r.id: r.n for r in files.select("id", content_id().alias("n")).collect()}
    source = str(tmp_path / "events")
    ingest = Ingest(spark, str(tmp_path / "state"))
    ingest.start(files)
    batches = [[(0, "manifest.sqlite", None), (1, names[1], None)], [(2, "snapshot.sqlite", ["p1", "p3"]), (3, names[3], None)]]
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(source)
        ingest.run(source)
    got, state, _ = ingest.load()
    assert {r.id: (r.phase, r.flags) for r in got.collect()} == {1: ("unarchived", 1), 2: ("unarchived", 0), 3: ("archived", 1), 4: ("archived", 0), 5: ("archived", 0)}
    assert (state.last_index, state.snapshots, state.saw_manifest) == (3, 1, True)


def test_command_line(root, tmp_path, capsys):
    from holdfast.__main__ import main, suffix_format

    p = os.path.join(root, "sub", "deep", "zeros.bin")
    assert main(["sparse-count", p]) == 0 and capsys.readouterr().out.strip() == "5"
    assert main(["sparse-copy", p, str(tmp_path / "copy")]) == 0
    assert (suffix_format("A.TAR.XZ"), suffix_format("x.tgz"), suffix_format("x")) == ("xz", "gzip", "none")
    with pytest.raises(SystemExit):
        main(["--help"])


def test_attributes(tmp_path):
    entries = {"user-obj": 6, "user:1000": 4, "group-obj": 4, "mask": 4, "other": 0}
    assert tree.parse_acl(tree.build_acl(entries)) == entries
    p = tmp_path / "a"
    p.write_bytes(b"x")
    try:
        os.setxattr(p, "user.note", b"\xff1")
    except OSError:
        pytest.skip("no user attributes here")
    row = tree.entry(str(tmp_path), str(p), attributes=True)
    q = tmp_path / "b"
    q.write_bytes(b"x")
    assert tree.restore_attributes(str(q), row["xattr"], row["acl"]) == [] and os.getxattr(q, "user.note") == b"\xff1"


def test_shutdown_stops_between_steps(spark, root, tmp_path):
    from holdfast.plans.shutdown import Shutdown

    stop = Shutdown(spark)
    stop.request()
    assert stop.requested and not stop.forced
    o = runner.ArchiveOptions(root=root, archive=str(tmp_path / "x.tar"), compression="none")
    assert runner.archive(spark, o, stop) == "inventory"
    assert runner.archive(spark, o) == "done"


def test_made_files(tmp_path):
    from holdfast.__main__ import main
    from holdfast.functions.units import size_of

    p = str(tmp_path / "m")
    assert main(["make-file", p, "--size", "64Kib", "--dirty", "3", "-b", "1024"]) == 0
    from holdfast.operators.sparse import inspect, read_chunks

    assert inspect(read_chunks(p), 1024)[1:3] == (65536, 61)
    assert [size_of(x) for x in ("4096", "1Kb", "2.5Kib")] == [4096, 1000, 2560]
    with pytest.raises(ValueError):
        size_of("x")
