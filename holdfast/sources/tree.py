"""Directory trees as a Spark data source: ``spark.read.format("tree").load(root)``.

One row per entry below the root, the root itself included with ``rel_path`` ''; links are not followed.
Unlike a listing of files it has directories, empty and dot files, and links as links. Partitions are the
entries of the first level (options ``partitions`` and ``attributes``), so a tree is walked in parallel on
a file system that all executors share. Entries that can't be read are left out.
"""

from __future__ import annotations

import base64
import json
import os
import stat
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import extension
from ..schema import conform

SCHEMA = "rel_path string, size long, mtime timestamp, atime timestamp, ctime timestamp, uid long, gid long, mode long, ftype string, xattr string, acl string, selinux binary, link_dst string"
#: Tags of access list entries in the attribute that holds them.
ACL_TAGS = {1: "user-obj", 2: "user", 4: "group-obj", 8: "group", 16: "mask", 32: "other"}
ACL_NAME = "system.posix_acl_access"
_ARROW = pa.schema([("rel_path", pa.string()), ("size", pa.int64()), *((n, pa.timestamp("us", "UTC")) for n in ("mtime", "atime", "ctime")), ("uid", pa.int64()), ("gid", pa.int64()), ("mode", pa.int64()), ("ftype", pa.string()), ("xattr", pa.string()), ("acl", pa.string()), ("selinux", pa.binary()), ("link_dst", pa.string())])
BATCH = 2048


def kind(mode: int) -> str:
    """Type of an entry that is no link."""
    for test, name in ((stat.S_ISREG, "file"), (stat.S_ISDIR, "dir"), (stat.S_ISFIFO, "fifo"), (stat.S_ISCHR, "char_dev"), (stat.S_ISBLK, "block_dev"), (stat.S_ISSOCK, "socket")):
        if test(mode):
            return name
    return "unknown"


def link_kind(path: str) -> str:
    """Type at the end of a chain of links: 'cycle' on a revisit, 'dangling' where nothing is."""
    seen, at = set(), os.path.abspath(path)
    while True:
        if at in seen:
            return "cycle"
        seen.add(at)
        try:
            mode = os.lstat(at).st_mode
        except FileNotFoundError:
            return "dangling"
        except OSError:
            return "unknown"
        if not stat.S_ISLNK(mode):
            return kind(mode)
        try:
            at = os.path.normpath(os.path.join(os.path.dirname(at), os.readlink(at)))
        except OSError:
            return "unknown"


def parse_acl(raw: bytes) -> dict[str, int]:
    """Permission bits by qualifier of a binary access list (version 2)."""
    out, undefined = {}, 0
    for tag, perm, number in struct.iter_unpack("<HHI", raw[4 : 4 + (len(raw) - 4) // 8 * 8]):
        name = ACL_TAGS.get(tag)
        if name is None:
            name, undefined = f"undefined-{undefined}", undefined + 1
        out[f"{name}:{number}" if name in ("user", "group") else name] = perm
    return out


def build_acl(entries: dict[str, int]) -> bytes:
    """:func:`parse_acl` undone; undefined entries can't be set and are left out."""
    tags, out = {v: k for k, v in ACL_TAGS.items()}, []
    for name, perm in entries.items():
        kind, _, number = name.partition(":")
        if kind in tags:
            out.append((tags[kind], perm, int(number) if number else 0xFFFFFFFF))
    return struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in sorted(out))


def restore_attributes(path: str, xattr: str | None, acl: str | None) -> list[str]:
    """Set stored attributes and access list; returns the names that could not be set."""
    failed = []
    stored = json.loads(xattr) if xattr else {"data": {}}
    plain = (lambda t: base64.b64decode(t)) if stored.get("encoding") == "base64" else (lambda t: t.encode())
    values = {plain(k).decode(): plain(v) for k, v in stored["data"].items()}
    if acl:
        values[ACL_NAME] = build_acl(json.loads(acl))
    for name, value in values.items():
        try:
            os.setxattr(path, name, value, follow_symlinks=False)
        except OSError:
            failed.append(name)
    return failed


def _attributes(path: str) -> tuple[str | None, str | None, bytes | None]:
    """User attributes as JSON with base64 keys and values, the access list as JSON by qualifier, and the
    security context."""
    try:
        names = os.listxattr(path, follow_symlinks=False)
    except OSError:
        return None, None, None
    code = lambda b: base64.b64encode(b).decode()
    data, acl, context = {}, None, None
    for name in names:
        try:
            value = os.getxattr(path, name, follow_symlinks=False)
        except OSError:
            continue
        data[code(name.encode())] = code(value)
        if name == "security.selinux":
            context = value
        if name == ACL_NAME:
            acl = json.dumps(parse_acl(value), sort_keys=True)
    return json.dumps({"encoding": "base64", "data": data}, sort_keys=True), acl, context


def entry(root: str, path: str, attributes: bool = False) -> dict | None:
    try:
        s = os.lstat(path)
    except OSError:
        return None
    time = lambda ns: datetime.fromtimestamp(ns // 10**9, timezone.utc).replace(microsecond=ns % 10**9 // 1000)
    rel = os.path.relpath(path, root)
    row = {"rel_path": "" if rel == "." else rel, "size": s.st_size, "mtime": time(s.st_mtime_ns), "atime": time(s.st_atime_ns), "ctime": None, "uid": s.st_uid, "gid": s.st_gid, "mode": s.st_mode, "link_dst": None, "xattr": None, "acl": None, "selinux": None}
    row["rel_path"] = row["rel_path"].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    if stat.S_ISLNK(s.st_mode):
        row["ftype"] = "symlink_" + link_kind(path)
        try:
            row["link_dst"] = os.readlink(path).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        except OSError:
            pass
    else:
        row["ftype"] = kind(s.st_mode)
    if hasattr(s, "st_birthtime_ns"):
        row["ctime"] = time(s.st_birthtime_ns)
    if attributes:
        row["xattr"], row["acl"], row["selinux"] = _attributes(path)
    return row


class _Part(InputPartition):
    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.normpath(options["path"])
        self.count = int(options.get("partitions", 64))
        self.attributes = str(options.get("attributes", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        top = [self.root]
        try:
            below = sorted(e.path for e in os.scandir(self.root))
        except OSError:
            below = []
        n = max(1, min(self.count, len(below)))
        return [_Part(top, False), *(_Part(below[i::n], True) for i in range(n) if below[i::n])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path in part.paths:
            for found in self._walk(path) if part.deep else [path]:
                if row := entry(self.root, found, self.attributes):
                    rows.append(row)
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _walk(self, path: str) -> Iterator[str]:
        stack = [path]
        while stack:
            at = stack.pop()
            yield at
            if os.path.isdir(at) and not os.path.islink(at):
                try:
                    stack += sorted((e.path for e in os.scandir(at)), reverse=True)
                except OSError:
                    pass


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, partitions: int = 64, attributes: bool = False) -> DataFrame:
    """The tree's catalog, phase inventoried; ids follow the paths' order."""
    from ..operators.offsets import with_offsets

    spark.dataSource.register(TreeSource)
    rows = spark.read.format("tree").option("partitions", partitions).option("attributes", str(attributes).lower()).load(root)
    rows = with_offsets(rows, ["rel_path"]).withColumn("id", F.col("position")).drop("position", "offset")
    return conform(rows.withColumn("ext", F.when(F.col("ftype") == "dir", "").otherwise(extension(F.col("rel_path")))))


def owner_names(numbers: DataFrame) -> DataFrame:
    """``numbers(kind, number)``, kind user or group, -> (kind, number, name); unknown numbers have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import grp
        import pwd

        for b in batches:
            names = []
            for of, number in zip(b.column("kind").to_pylist(), b.column("number").to_pylist()):
                try:
                    names.append(pwd.getpwuid(number).pw_name if of == "user" else grp.getgrgid(number).gr_name)
                except (KeyError, OverflowError):
                    names.append(None)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("number"), pa.array(names, pa.string())], ["kind", "number", "name"])

    return numbers.select("kind", F.col("number").cast("long")).mapInArrow(run, "kind string, number long, name string")
