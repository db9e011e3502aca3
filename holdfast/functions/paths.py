"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of archives, longest first where one ends another.
SUFFIXES = {"xz": [".tar.xz", ".txz"], "gzip": [".tar.gz", ".tgz"], "bzip2": [".tar.bz2", ".tbz2", ".tbz"], "zstd": [".tar.zst", ".tzst"], "none": [".tar"]}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the last part, '' if there is none or it leads the name."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """'/' for what lies in the root and the root itself, '.' for a bare name."""
    trimmed = F.regexp_replace(path, r"(?<=.)/+$", "")
    up = F.regexp_replace(F.regexp_extract(trimmed, r"^(.*)/[^/]*$", 1), r"(?<=.)/+$", "")
    return F.when(up != "", up).when(path.startswith("/"), "/").otherwise(".")


def compression(path: Column) -> Column:
    """Format by suffix, without regard to case; 'none' for others."""
    low, out = F.lower(path), F
    for name, ends in SUFFIXES.items():
        for end in ends:
            out = out.when(low.endswith(end), name)
    return out.otherwise("none")


def archive_stem(path: Column) -> Column:
    """The basename without its archive suffix, or without its extension if that is no archive's."""
    name = basename(path)
    low, out = F.lower(name), F
    for end in (e for ends in SUFFIXES.values() for e in ends):
        out = out.when(low.endswith(end), F.substring(name, F.lit(1), F.length(name) - len(end)))
    return out.otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def work_dir(path: Column, suffix: str = ".astage") -> Column:
    up = parent(path)
    return F.concat(F.when(up == "/", up).otherwise(F.concat(up, F.lit("/"))), archive_stem(path), F.lit(suffix))


def clean(path: Column) -> Column:
    """Lexical normal form: no '.', no empty parts, '..' folded where a part precedes it."""

    def step(done: Column, part: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & last.isNotNull() & (last != ".."), F.slice(done, 1, F.size(done) - 1))
            .when((part == "..") & path.startswith("/"), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def relative(path: Column, root: Column) -> Column:
    """The cleaned path below the root ('' for the root itself), null outside of it."""
    p, r = clean(path), F.regexp_replace(clean(root), "/$", "")
    return F.when(p == r, "").when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p)))


def resolve(link: Column, target: Column) -> Column:
    """Where a link at ``link`` points."""
    return F.when(target.startswith("/"), clean(target)).otherwise(clean(F.concat(parent(link), F.lit("/"), target)))


def is_safe(path: Column) -> Column:
    """Neither absolute nor with a '..' part."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
