"""The two state machines: make an archive of a tree, and restore a tree from an archive.

Every step reads the version of the catalog that the step before it wrote, as Parquet, and writes the
next; the run's state is a JSON file that is replaced whole, so a run that stopped resumes at its step. On
a cluster the tree, the work folder and the archive lie on a file system that all executors share.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as dd
from ..operators import keyed, reports
from ..operators import sparse as sp
from ..operators import transitions as tr
from ..operators.compare import changed_files, compare_files
from ..operators.predicates import cached_payload_ids, in_phase, is_file, sparsify_candidate
from ..operators.restore import restore_plan, stage_plan, unrestored
from ..operators.scan import ScanError, ScanState, completeness, members, misplaced, outcome
from ..schema import ARCHIVE_STEPS, EXTRACT_STEPS, MANIFEST, SESSIONS, SNAPSHOT, STRIPPED
from ..session import ship
from ..sources import archive as ar
from ..sources.tree import owner_names, read_tree, restore_attributes
from .shutdown import Shutdown
from . import start


#: Parts of a work folder that hold contents, not catalogs.
STAGED = ("sparse", "cache")


class _Work:
    """A work folder: the run's state, the versions of the catalog, a lock."""

    def __init__(self, folder: str):
        self.folder, self.state_path = folder, os.path.join(folder, "state.json")

    def state(self) -> dict | None:
        try:
            with open(self.state_path) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def save(self, **state) -> None:
        with open(self.state_path + ".new", "w") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.state_path + ".new", self.state_path)

    def path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def wipe(self, keep_db: bool = False, keep_stage: bool = False) -> None:
        """Remove what the run left: catalogs and state, and staged contents, or one of both."""
        if not os.path.isdir(self.folder):
            return
        for name in os.listdir(self.folder):
            if keep_stage if name in STAGED else keep_db:
                continue
            path = self.path(name)
            shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        if not os.listdir(self.folder):
            os.rmdir(self.folder)

    def lock(self):
        os.makedirs(self.folder, exist_ok=True)
        f = open(self.path("lock"), "w")
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            f.close()
            raise RuntimeError(f"another run works in {self.folder}") from e
        return f

    def keep(self, files: DataFrame, step: str) -> DataFrame:
        path = self.path(f"catalog-{step}")
        files.write.mode("overwrite").parquet(path)
        return files.sparkSession.read.schema(files.schema).parquet(path)

    def sessions(self, spark: SparkSession) -> DataFrame:
        """The log of sessions in its last version."""
        last = (self.state() or {}).get("sessions", 0)
        return spark.read.schema(SESSIONS).parquet(self.path(f"sessions-{last}")) if last else spark.createDataFrame([], SESSIONS)

    def log(self, sessions: DataFrame, **state) -> DataFrame:
        """The next version of the sessions' log, and the run's state with it."""
        now = self.state() or {}
        number = now.get("sessions", 0) + 1
        sessions.coalesce(1).write.mode("overwrite").parquet(self.path(f"sessions-{number}"))
        self.save(**now | {"sessions": number} | state)
        return self.sessions(sessions.sparkSession)


@dataclass
class ArchiveOptions:
    root: str
    archive: str
    work: str | None = None
    compression: str = "xz"
    level: int | None = None
    extreme: bool = False
    page_size: int = sp.PAGE
    min_pages: int | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    verify: bool = True
    fail_fast: bool = False
    retry_missing_sha: bool = False
    attributes: bool = False
    footer: bool = True
    jobs: int = 1
    memory: int | None = None
    resume: bool = False
    fresh: bool = False
    keep_db: bool = False
    keep_stage: bool = False
    keep_work: bool = False
    stop_after: str | None = None


def archive(spark: SparkSession, o: ArchiveOptions, shutdown: Shutdown | None = None, notes: list[str] | None = None) -> str:
    """Archive a tree; returns 'done' or the step after which, or in which, it stopped (by option or on request).
    Warnings are added to ``notes``. A file that no run in this work folder began is never replaced, unless by
    ``fresh``."""
    ship(spark)
    work, notes, shutdown = _Work(o.work or o.archive + ".astage"), [] if notes is None else notes, shutdown or Shutdown(spark)
    saved = work.state()
    action = start.resolve(start.policy(o.resume, o.fresh), bool(saved and saved["step"] != "done"), ar.has_footer(o.archive) if os.path.exists(o.archive) else False)
    if action == "done":
        return "done"
    if action == "fresh":
        if os.path.exists(o.archive):
            if not o.fresh:
                raise start.StartError(f"{o.archive} exists and is no archive that this run began; ask for a fresh one to replace it")
            os.remove(o.archive)
        work.wipe()
    with work.lock():
        step = saved["step"] if action == "resume" else ARCHIVE_STEPS[0]
        version = saved.get("version") if action == "resume" else None
        while step != "done":
            files = spark.read.parquet(work.path(f"catalog-{version}")) if version else None
            run = _Run(spark, o, work, notes, shutdown)
            files = _ARCHIVE[step](run, files)
            done, version = step, f"{step}-{(work.state() or {}).get('sessions', 0)}"
            work.keep(files, version)
            if not run.stopped:
                step = ARCHIVE_STEPS[ARCHIVE_STEPS.index(step) + 1]
            work.save(**(work.state() or {}) | {"step": step, "version": version})
            if run.stopped or step != "done" and (o.stop_after == done or shutdown.requested):
                return done
    if not o.keep_work:
        work.wipe(o.keep_db, o.keep_stage)
    return "done"


@dataclass
class _Run:
    """What a step of a run works with; ``stopped`` says that it ended before its work did."""

    spark: SparkSession
    o: ArchiveOptions | ExtractOptions
    work: _Work
    notes: list[str]
    shutdown: Shutdown
    stopped: bool = False

    def path(self) -> Column:
        """Where a catalog row's file lies in the tree."""
        return F.concat(F.lit(self.o.root.rstrip("/") + "/"), F.col("rel_path"))

    def note(self, rows: DataFrame, what: str, most: int = 5) -> int:
        """How many rows(rel_path) there are, and the first of them, as a warning."""
        n = rows.count()
        if n:
            first = ", ".join(r.rel_path for r in rows.select("rel_path").orderBy("rel_path").limit(most).collect())
            self.notes.append(f"{n} file(s) {what}: {first}{', ...' if n > most else ''}")
        return n

    def warn_of_changes(self, files: DataFrame, before: str) -> None:
        """Files that are gone or whose times differ by seconds from the inventory's."""
        for problem in ("gone", "changed since the inventory"):
            self.note(changed_files(files.where(is_file()), self.path()).where(F.col("problem") == problem), f"{problem} (seen before {before})")


def _inventory(run: _Run, files):
    files = read_tree(run.spark, run.o.root, attributes=run.o.attributes)
    names = owner_names(reports.distinct_owners(files))
    users, groups = (names.where(F.col("kind") == k).select(F.col("number").alias(n), "name") for k, n in (("user", "uid"), ("group", "gid")))
    return tr.fill_names(files, users, groups)


def _inspected(run: _Run, files: DataFrame) -> DataFrame:
    paths = files.select("id", run.path().alias("path"))
    return sp.inspect_paths(paths.repartition(max(8, run.spark.sparkContext.defaultParallelism * 4), "id"), run.o.page_size)


def _hash(run: _Run, files):
    """Digests and zero pages of regular files; what can't be read, on request at a second time, keeps no digest."""
    files = run.work.keep(tr.set_inspection(files, _inspected(run, files.where(is_file()))), "hashing")
    if run.o.retry_missing_sha:
        files = run.work.keep(tr.set_inspection(files, _inspected(run, files.where(is_file() & F.col("sha1").isNull()))), "hashing-again")
    run.note(files.where(is_file() & F.col("sha1").isNull()), "could not be read and will have no payload")
    return tr.update(files, in_phase("inventoried"), phase="hashed")


def _dedup(run: _Run, files):
    """Equal digests and sizes are compared byte by byte, unless ``verify`` is off."""
    files = tr.apply_filter(files, run.o.include, run.o.exclude)
    if not run.o.verify:
        return dd.dedup(files)
    files = run.work.keep(files, "filtered")
    run.warn_of_changes(files.where(in_phase("filtered")), "comparing")
    out = run.work.keep(dd.dedup_files(files, files.select("id", run.path().alias("path")), compare_files, run.o.fail_fast), "deduping")
    run.note(out.where(F.col("flags").bitwiseAND(F.lit(16)) != 0), "could not be read when they were compared")
    crowded = tr.crowded_canonicals(out).first()
    if crowded or reports.dedup_progress(out).first().electable:
        raise RuntimeError("the deduplication left files undecided")
    return out


def _sparsify(run: _Run, files):
    o, work = run.o, run.work
    files = tr.skip_sparsify(files, o.min_pages)
    if o.min_pages is None:
        return files
    os.makedirs(work.path("sparse"), exist_ok=True)
    from ..functions.content import content_id

    copies = files.where(in_phase("deduped") & sparsify_candidate(o.min_pages)).select("id", run.path().alias("source"), F.concat(F.lit(work.path("sparse") + "/sp."), content_id()).alias("target"))
    return tr.set_sparsified(files, sp.sparse_copies(copies, o.page_size))


def _stage(run: _Run, files):
    return tr.archive_ineligible(tr.stage(files))


def _archive(run: _Run, files):
    """A session: payloads in packing order and a snapshot; the manifest before the first one, the footer behind
    the last. A session that was not ended is cut off the file and its members are written again; one that is
    stopped on request ends after a member, and the next one goes on with the rest."""
    o, work = run.o, run.work
    sessions = work.sessions(run.spark)
    if not os.path.exists(o.archive) and sessions.limit(1).count():
        sessions, files = sessions.limit(0), tr.reset_archive(files)
        run.notes.append("the archive is gone; it is written anew")
    sessions, files, cut = keyed.recover(sessions, files)
    if cut is not None:
        ar.cut_at(o.archive, cut)
    state = work.state()
    if os.path.exists(o.archive) and ar.has_footer(o.archive) and ar.footer_offset(o.archive) == state.get("archive_bytes"):
        ar.cut_at(o.archive, state["archive_bytes"])  # a run that stopped behind its footer
    length = os.path.getsize(o.archive) if os.path.exists(o.archive) else 0
    if reports.has_finalized_session(sessions) and length != state.get("archive_bytes"):
        raise RuntimeError(f"the archive has {length} bytes; after its last session it had {state.get('archive_bytes')}")
    if not reports.has_finalized_session(sessions):
        ar.cut_at(o.archive, 0)
        length = 0
    sessions = work.log(keyed.begin_session(sessions, length))
    number = reports.latest_open_session(sessions).first().id
    rows = files.where(in_phase("staged"))
    run.warn_of_changes(rows, "archiving")
    plan = stage_plan(rows, o.root, work.path("sparse")).orderBy("ext", "size", "id")
    total, done = plan.count(), 0
    writer = ar.ArchiveWriter(o.archive, o.compression, o.level, o.extreme, o.jobs, o.memory)
    try:
        if not length:
            writer.add_catalog(ar.write_catalog(files, work.path(MANIFEST), _meta(o)), first=True)
        with ar.RowLog(work.path(f"written-{number}.parquet"), ("id", "problem"), (pa.int64(), pa.string())) as log:
            for id, problem in ar.write_members(writer, _until(run.shutdown, plan.toLocalIterator())):
                log.add(id, problem)
                done += 1
        if run.shutdown.forced:
            raise KeyboardInterrupt
        run.stopped = done < total
        written = run.spark.read.parquet(log.path)
        bad = written.where("problem is not null").select("id")
        out = tr.archive_appended(tr.mark_appended(files, written.where("problem is null").select("id")))
        # what could not be read is settled without payload
        out = tr.set_flags(out, bad, "archive_error")
        out = tr.update(out, in_phase("staged") & (F.col("flags").bitwiseAND(F.lit(128)) != 0), phase="archived")
        out = work.keep(out if run.stopped else tr.archive_remainder(out), f"session-{number}")
        run.note(out.join(bad, "id", "left_semi"), "could not be read and have no whole payload")
        writer.add_catalog(ar.write_catalog(out, work.path(SNAPSHOT), _meta(o)), first=False)
        size = writer.close(last=not run.stopped)
    except BaseException:
        writer.abandon()
        work.log(keyed.abort_session(sessions, number))
        raise
    work.log(keyed.finalize_session(sessions, number), archive_bytes=size, version=f"session-{number}")
    if o.footer and not run.stopped:
        ar.write_footer(o.archive, work.path(SNAPSHOT))
    return out


def _until(shutdown: Shutdown, rows: Iterable) -> Iterator:
    """Rows until a stop is requested, asked between two of them."""
    for r in rows:
        if shutdown.requested:
            return
        yield r


def _meta(o: ArchiveOptions) -> dict[str, str]:
    return {"root": o.root, "compression": o.compression, "page_size": str(o.page_size), "written_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}


_ARCHIVE = {"inventory": _inventory, "hash": _hash, "dedup": _dedup, "sparsify": _sparsify, "stage": _stage, "archive": _archive}


@dataclass
class ExtractOptions:
    archive: str
    output: str
    work: str | None = None
    cache: str | None = None
    force: bool = False
    rehash: bool = True
    restore_owner: bool = False
    restore_mode: bool = True
    restore_attributes: bool = False
    overwrite: bool = True
    resume: bool = False
    fresh: bool = False
    keep_db: bool = False
    keep_stage: bool = False
    keep_work: bool = False


def extract(spark: SparkSession, o: ExtractOptions, shutdown: Shutdown | None = None) -> list[str]:
    """Restore a tree; returns warnings."""
    ship(spark)
    work, shutdown = _Work(o.work or o.output.rstrip("/") + ".estage"), shutdown or Shutdown(spark)
    saved = work.state()
    action = start.resolve(start.policy(o.resume, o.fresh), bool(saved and saved["step"] != "done"), False)
    if action == "fresh":
        work.wipe()
    notes: list[str] = []
    with work.lock():
        os.makedirs(_cache(o, work), exist_ok=True)
        step = saved["step"] if action == "resume" else EXTRACT_STEPS[0]
        version = saved.get("version") if action == "resume" else None
        while step not in ("cleanup", "done"):
            files = spark.read.parquet(work.path(f"catalog-{version}")) if version else None
            run = _Run(spark, o, work, notes, shutdown)
            files = _EXTRACT[step](run, files)
            if run.stopped:
                return [*notes, f"stopped in {step}; resume to go on"]
            work.keep(files, step)
            version, step = step, EXTRACT_STEPS[EXTRACT_STEPS.index(step) + 1]
            work.save(step=step, version=version)
            if shutdown.requested and step != "cleanup":
                return [*notes, f"stopped before {step}; resume to go on"]
        work.save(step="done", version=version)
    if not o.keep_work:
        work.wipe(o.keep_db, o.keep_stage)
    if o.cache and not (o.keep_work or o.keep_stage):
        shutil.rmtree(o.cache, ignore_errors=True)
    return notes


def _cache(o: ExtractOptions, work: _Work) -> str:
    return o.cache or work.path("cache")


def _scan(run: _Run, files):
    """Members in order into the cache; the catalog from the footer or the leading manifest; every later
    snapshot confirms what was extracted before it. The place in the stream is saved after every member, so
    a scan that was stopped goes on behind the last one it has whole."""
    spark, o, work, notes = run.spark, run.o, run.work, run.notes
    saved = (work.state() or {}).get("scan")
    state = ScanState(**saved) if saved else ScanState()
    resumed, began = saved is not None, state.next_index()
    if not state.from_footer and ar.has_footer(o.archive):
        ar.read_footer(o.archive, work.path("footer.sqlite"))
        state = replace(state, from_footer=True)

    def target(index: int, name: str) -> str:
        base = os.path.basename(os.path.normpath(name))
        kind = _kind(base)
        if kind == "manifest" and state.saw_any:
            raise ScanError("the manifest is not the first member")
        if not state.saw_any and kind != "manifest" and not o.force:
            raise ScanError(f"the first member is {base}, no manifest")
        return os.path.join(_cache(o, work), base) if kind == "payload" else work.path(f"{kind}-{index}.sqlite")

    with ar.member_index(work.path(f"members-{began}.parquet")) as seen:
        for index, name in ar.copy_members(o.archive, began, target):
            seen.add(index, name)
            state = state.seen(index, _kind(os.path.basename(os.path.normpath(name))))
            if run.shutdown.requested:
                run.stopped = True
                break
    state = replace(state, complete=not run.stopped)
    work.save(step="scan_tar", version=None, scan=vars(state))
    if run.stopped:
        return files
    found = sorted((int(x.split("-")[1].split(".")[0]), work.path(x)) for x in os.listdir(work.folder) if x.startswith("snapshot-") and x.endswith(".sqlite"))
    first = [work.path(x) for x in ("footer.sqlite", "manifest-0.sqlite") if os.path.exists(work.path(x))] + [path for _, path in found]
    if not first:
        raise ScanError("no catalog in the archive")
    said = outcome(state, resumed)
    if not said.startswith("complete"):
        notes.append(said)
    files = tr.normalise_installed(ar.read_catalog(spark, first[0]))
    rows = spark.read.schema("member_index long, name string").parquet(work.path("members-*.parquet")).dropDuplicates(["member_index"])
    listed = work.keep(members(rows), "members")
    odd = misplaced(listed, o.force).orderBy("member_index").first()
    if odd:
        raise ScanError(f"{odd.name}: {odd.problem}")
    payloads = listed.where("kind = 'payload'").select("member_index", F.col("payload_id").alias("id"))
    for index, path in found:  # a version for each snapshot: updates on updates make plans that grow without bound
        files = work.keep(tr.mark_extracted(files, payloads.where(F.col("member_index") < index)), f"before-{index}")
        files = work.keep(tr.confirm_snapshot(files, ar.read_catalog(spark, path))[0], f"after-{index}")
    # what lies in the cache counts as extracted, by whichever run
    cached = spark.createDataFrame([(x,) for x in os.listdir(_cache(o, work)) if not x.endswith(".part")], "name string")
    files = work.keep(tr.mark_extracted(files, cached_payload_ids(cached)), "extracted")
    if state.from_footer or o.force:
        files = tr.salvage(files)
    files = work.keep(files, "scanned")
    notes += completeness(reports.extraction_counts(files).first(), state.from_footer, o.force)
    return files


def _kind(name: str) -> str:
    return "manifest" if name == MANIFEST else "snapshot" if name == SNAPSHOT else "payload"


def _rehash(run: _Run, files):
    if not run.o.rehash:
        return files
    plan = restore_plan(files, ("unarchived",)).select(F.col("canonical_id").alias("id"), F.concat(F.lit(_cache(run.o, run.work) + "/"), F.col("member")).alias("path")).distinct()
    files = run.work.keep(tr.verify_rehash(files, sp.inspect_paths(plan)), "rehashing")
    bad = files.where(F.col("flags").bitwiseAND(F.lit(256)) != 0).count()
    if bad:
        run.notes.append(f"{bad} file(s) differ from their digest")
    return files


def _place(run: _Run, files):
    """Directories, files and links under the output folder, by the executors. What the catalog has and the
    archive can't give is an error, unless forced, and always said."""
    o, spark = run.o, run.spark
    owner, mode, extra, output, cache, again = o.restore_owner, o.restore_mode, o.restore_attributes, o.output, _cache(o, run.work), o.overwrite
    os.makedirs(output, exist_ok=True)
    plan = run.work.keep(restore_plan(files), "placing")
    unsafe = plan.where(~F.col("safe")).count()
    if unsafe:
        raise ScanError(f"{unsafe} path(s) leave the output folder")
    run.note(unrestored(files), "of the catalog have no payload and are not restored")
    gone = changed_files(plan.select("id", "rel_path", "member", *(F.lit(None).cast("timestamp").alias(t) for t in ("mtime", "atime", "ctime"))), F.concat(F.lit(cache + "/"), F.col("member")))
    gone = run.work.keep(gone, "uncached")
    if run.note(gone, "lack their payload in the cache") and not o.force:
        raise ScanError(run.notes[-1])
    plan = plan.join(gone, "id", "left_anti")
    from ..functions.paths import is_safe

    dirs = files.where((F.col("ftype") == "dir") & (F.col("rel_path") != "") & is_safe(F.col("rel_path"))).select("rel_path")
    dirs.foreachPartition(lambda rows: [os.makedirs(os.path.join(output, r.rel_path), exist_ok=True) for r in rows] and None)

    def put(rows):
        for r in rows:
            target = os.path.join(output, r.rel_path)
            if not again and os.path.lexists(target):
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.copyfile(os.path.join(cache, r.member), target + ".part")
            if owner and r.uid is not None:
                os.chown(target + ".part", r.uid, r.gid if r.gid is not None else -1)
            if mode and r.mode is not None:
                os.chmod(target + ".part", r.mode & 0o7777)
            if extra:
                restore_attributes(target + ".part", r.xattr, r.acl)
            if r.mtime is not None:
                t = r.mtime.timestamp()
                os.utime(target + ".part", (t, t))
            os.replace(target + ".part", target)

    def link(rows):
        for r in rows:
            target = os.path.join(output, r.rel_path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if not os.path.lexists(target):
                os.symlink(r.link_dst, target)

    plan.repartition(max(8, spark.sparkContext.defaultParallelism), "id").foreachPartition(put)
    files.where(F.col("ftype").startswith("symlink_") & F.col("link_dst").isNotNull() & is_safe(F.col("rel_path"))).select("rel_path", "link_dst").foreachPartition(link)
    return tr.place(files, plan.select("id"))


def _permissions(run: _Run, files):
    return tr.update(files, in_phase("at_destination"), phase="permissions_restored")


_EXTRACT = {"scan_tar": _scan, "rehash": _rehash, "place": _place, "permissions": _permissions}


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of an archive without reading its payloads, where a footer has it."""
    target = path + ".catalog.sqlite"
    try:
        ar.read_footer(path, target)
    except ar.FooterError:
        for m in ar.read_members(path):
            if os.path.basename(m["name"]) in (MANIFEST, SNAPSHOT):
                with open(target, "wb") as f:
                    f.write(m["content"])
    return ar.read_catalog(spark, target).select(STRIPPED)


def diff(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, change) between a catalog and a tree: added, removed, changed (size or type)."""
    now = read_tree(files.sparkSession, root).select("rel_path", F.col("size").alias("now_size"), F.col("ftype").alias("now_ftype"))
    both = files.select("rel_path", "size", "ftype").join(now, "rel_path", "full")
    change = F.when(F.col("ftype").isNull(), "added").when(F.col("now_ftype").isNull(), "removed").when((F.col("ftype") != F.col("now_ftype")) | ((F.col("ftype") == "file") & (F.col("size") != F.col("now_size"))), "changed")
    return both.select("rel_path", change.alias("change")).where("change is not null")
