"""``python -m holdfast archive|extract|list|diff|sparse-copy|sparse-count|make-file``."""

from __future__ import annotations

import argparse
import os
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="holdfast")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("archive", help="deduplicate and archive a tree")
    a.add_argument("-f", "--file", required=True)
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-C", "--directory", help="the input is relative to it")
    a.add_argument("-w", "--work")
    how = a.add_mutually_exclusive_group()
    how.add_argument("-a", "--auto-compress", action="store_true", help="format by the archive's suffix (default)")
    for flag, name in (("-z", "gzip"), ("-j", "bzip2"), ("-J", "xz"), ("--zstd", "zstd"), ("--no-auto-compress", "none")):
        how.add_argument(flag, dest="compression", action="store_const", const=name)
    a.add_argument("--level", type=int)
    a.add_argument("--xz-extreme", action="store_true")
    a.add_argument("--bzip-small", action="store_true")
    a.add_argument("--page-size", type=int, default=4096)
    a.add_argument("--min-pages", type=int)
    a.add_argument("--include", action="append", default=[])
    a.add_argument("--exclude", action="append", default=[])
    a.add_argument("--attributes", action="store_true")
    a.add_argument("--jobs", type=int, default=1, help="threads that compress")
    a.add_argument("--memlimit-compress", help="memory that they may take, as 2GiB or 50%%")
    a.add_argument("--no-verify", action="store_true", help="trust equal digests without comparing bytes")
    a.add_argument("--fail-fast", action="store_true", help="don't compare a file again that could not be read")
    a.add_argument("--retry-missing-sha", action="store_true")
    a.add_argument("--no-footer", action="store_true")
    a.add_argument("--exit-after-stage")
    x = sub.add_parser("extract", help="restore a tree")
    x.add_argument("-f", "--file", required=True)
    x.add_argument("-C", "--output", required=True)
    x.add_argument("-w", "--work")
    x.add_argument("--extract-stage-location", help="folder for the members until they are placed")
    x.add_argument("--keep-existing", action="store_true", help="leave files that are there already")
    x.add_argument("--restore-owner", action="store_true")
    x.add_argument("--force-scan", action="store_true")
    x.add_argument("--no-rehash", action="store_true")
    x.add_argument("--attributes", action="store_true", help="set stored attributes and access lists")
    for s in (a, x):
        s.add_argument("--resume", action="store_true")
        s.add_argument("--fresh", action="store_true")
        s.add_argument("--keep-work", action="store_true")
        s.add_argument("--keep-db", action="store_true")
        s.add_argument("--keep-stage", action="store_true")
    t = sub.add_parser("list", help="the catalog of an archive")
    t.add_argument("-f", "--file", required=True)
    k = sub.add_parser("meta", help="the metadata of an archive's catalog")
    k.add_argument("-f", "--file", required=True)
    d = sub.add_parser("diff", help="an archive's catalog against a tree")
    d.add_argument("-f", "--file", required=True)
    d.add_argument("-i", "--input", required=True)
    c = sub.add_parser("sparse-copy", help="copy a file with holes for zero pages")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-v", "--verbose", action="store_true", help="also say what the copy takes and saves")
    c.add_argument("-l", "--list-only", action="store_true", help="only count, write nothing")
    m = sub.add_parser("make-file", help="write a test file with a few dirty pages")
    m.add_argument("output")
    m.add_argument("--size", default="1Mib")
    m.add_argument("--dirty", type=int, default=1)
    m.add_argument("--seed", type=int, default=0)
    n = sub.add_parser("sparse-count", help="count full zero pages of a file")
    n.add_argument("input")
    for s in (c, n, m):
        s.add_argument("-b", "--block-size", type=int, default=4096)
    return p


def main(argv: list[str] | None = None) -> int:
    o = _parser().parse_args(argv)
    from .functions.units import size_of
    from .operators.sparse import inspect, make_file, read_chunks, sparse_copy

    if o.command == "sparse-copy":
        if o.list_only:
            _, size, zero, saved = inspect(read_chunks(o.input), o.block_size)
            print(f"{size} bytes, {zero} zero block(s), {saved} bytes to save")
            return 0
        stats = sparse_copy(o.input, o.output, o.block_size)
        if o.verbose:
            print(f"{stats.size_in} bytes, {stats.size_out} on disk, {stats.zero_blocks} zero block(s), {stats.bytes_saved} bytes saved")
        return 0
    if o.command == "make-file":
        make_file(o.output, size_of(o.size), o.block_size, o.dirty, o.seed)
        return 0
    if o.command == "sparse-count":
        print(inspect(read_chunks(o.input), o.block_size)[2])
        return 0
    if o.command == "meta":
        for key, value in sorted(archive_meta(o.file).items()):
            print(key, value, sep="\t")
        return 0
    from pyspark.sql import SparkSession

    from .plans import runner
    from .plans.shutdown import Shutdown

    spark = SparkSession.builder.appName("holdfast").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "archive":
        if o.bzip_small and o.level not in (None, 1):
            raise SystemExit("--bzip-small means level 1")
        from .functions.units import limit_of

        notes: list[str] = []
        with Shutdown(spark) as stop:
            done = runner.archive(
                spark,
                runner.ArchiveOptions(
                    root=os.path.join(o.directory or "", o.input), archive=o.file, work=o.work, compression=o.compression or suffix_format(o.file), level=1 if o.bzip_small else o.level,
                    extreme=o.xz_extreme, page_size=o.page_size, min_pages=o.min_pages, include=o.include, exclude=o.exclude, verify=not o.no_verify, fail_fast=o.fail_fast,
                    retry_missing_sha=o.retry_missing_sha, attributes=o.attributes, footer=not o.no_footer, jobs=o.jobs, memory=limit_of(o.memlimit_compress) if o.memlimit_compress else None,
                    resume=o.resume, fresh=o.fresh, keep_db=o.keep_db, keep_stage=o.keep_stage, keep_work=o.keep_work, stop_after=o.exit_after_stage,
                ),
                stop,
                notes,
            )
        print(done)
        for note in notes:
            print(note, file=sys.stderr)
    elif o.command == "extract":
        with Shutdown(spark) as stop:
            notes = runner.extract(
                spark,
                runner.ExtractOptions(
                    archive=o.file, output=o.output, work=o.work, cache=o.extract_stage_location, force=o.force_scan, rehash=not o.no_rehash, restore_owner=o.restore_owner,
                    restore_attributes=o.attributes, overwrite=not o.keep_existing, resume=o.resume, fresh=o.fresh, keep_db=o.keep_db, keep_stage=o.keep_stage, keep_work=o.keep_work,
                ),
                stop,
            )
        for note in notes:
            print(note, file=sys.stderr)
    elif o.command == "list":
        for r in runner.list_archive(spark, o.file).orderBy("rel_path").toLocalIterator():
            print(r.ftype, r.size, r.rel_path, sep="\t")
    else:
        for r in runner.diff(runner.list_archive(spark, o.file), o.input).orderBy("rel_path").toLocalIterator():
            print(r.change, r.rel_path, sep="\t")
    return 0


def archive_meta(path: str) -> dict[str, str]:
    """The metadata in the catalog of an archive's footer, or of its last catalog member."""
    import tempfile

    from .schema import MANIFEST, SNAPSHOT
    from .sources import archive as ar

    with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
        try:
            f.write(ar.read_footer(path))
        except ar.FooterError:
            for m in ar.read_members(path):
                if os.path.basename(m["name"]) in (MANIFEST, SNAPSHOT):
                    f.seek(0)
                    f.truncate()
                    f.write(m["content"])
        f.flush()
        return ar.read_meta(f.name)


def suffix_format(path: str) -> str:
    from .functions.paths import SUFFIXES

    return next((name for name, ends in SUFFIXES.items() for end in ends if path.lower().endswith(end)), "none")


if __name__ == "__main__":
    sys.exit(main())
