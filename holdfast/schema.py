"""Tables, enumerations and flag bits of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

#: Labels, bits and states that stored catalogs hold.
FILE_TYPES = ["file", "dir", "fifo", "char_dev", "block_dev", "socket", "unknown", "symlink_file", "symlink_dir", "symlink_socket", "symlink_fifo", "symlink_char_dev", "symlink_block_dev", "symlink_dangling", "symlink_cycle", "symlink_unknown"]
LINK_TYPES = ["file", "dir", "fifo", "char_dev", "block_dev", "dangling", "cycle", "socket", "unknown"]
ARCHIVE_PHASES = ["inventoried", "hashed", "filtered", "deduped", "sparsified", "staged", "archived"]
EXTRACT_PHASES = ["unarchived", "rehashed", "at_destination", "permissions_restored"]
PHASES = ARCHIVE_PHASES + EXTRACT_PHASES
FLAGS = {"extracted": 0, "modified": 1, "has_sparse": 2, "checked": 3, "dedup_error": 4, "sparsify_error": 5, "appended": 6, "archive_error": 7, "rehash_mismatch": 8, "rehash_error": 9}
SESSION_OPEN, SESSION_FINALIZED, SESSION_ABORTED = 0, 1, 2
ARCHIVE_STEPS = ["inventory", "hash", "dedup", "sparsify", "stage", "archive", "done"]
EXTRACT_STEPS = ["scan_tar", "rehash", "place", "permissions", "cleanup", "done"]
#: Compression formats with their least and greatest level; the greatest is the default.
COMPRESSION = {"xz": (0, 9), "gzip": (1, 9), "bzip2": (1, 9), "zstd": (1, 19), "none": (0, 0)}
MANIFEST, SNAPSHOT = "manifest.sqlite", "snapshot.sqlite"


def bit(name: str) -> int:
    return 1 << FLAGS[name]


def _field(name: str, kind, required: bool = False) -> StructField:
    return StructField(name, kind, not required)


CATALOG = StructType(
    [
        _field("id", LongType(), True),
        _field("rel_path", StringType(), True),
        _field("ext", StringType(), True),
        _field("size", LongType(), True),
        _field("sha1", StringType()),
        *(_field(n, TimestampType()) for n in ("mtime", "atime", "ctime")),
        _field("uid", LongType()),
        _field("username", StringType()),
        _field("gid", LongType()),
        _field("groupname", StringType()),
        _field("mode", LongType()),
        _field("ftype", StringType()),
        _field("xattr", StringType()),
        _field("acl", StringType()),
        _field("selinux", BinaryType()),
        _field("link_dst", StringType()),
        _field("sparse_count", LongType()),
        _field("exclusion_id", LongType()),
        _field("canonical_id", LongType()),
        _field("phase", StringType(), True),
        _field("flags", LongType(), True),
    ]
)
#: The narrow projection that planning steps read.
STRIPPED = ["id", "rel_path", "ext", "size", "sha1", "mtime", "atime", "ctime", "ftype", "canonical_id", "phase", "flags"]
SESSIONS = "id long, archive_offset long, finalized int, started_at timestamp, finished_at timestamp"
META = "key string, value string"


def conform(df: DataFrame) -> DataFrame:
    """Columns of the catalog in order and type; missing ones are null (phase inventoried, flags 0)."""
    default = {"phase": F.lit("inventoried"), "flags": F.lit(0), "ext": F.lit("")}
    return df.select(*(F.coalesce(*([F.col(f.name)] if f.name in df.columns else []), default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in CATALOG))


def unknown_labels(df: DataFrame) -> DataFrame:
    """Rows whose phase or file type is no known label (reading them as such would be an error)."""
    return df.where(~F.col("phase").isin(PHASES) | (F.col("ftype").isNotNull() & ~F.col("ftype").isin(FILE_TYPES)))


def has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(bit(name))) != 0


def with_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseOR(F.lit(bit(name)))


def without_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(~bit(name)))


def flag_names(flags: Column) -> Column:
    """Names of the set bits, lowest first."""
    return F.filter(F.array(*(F.when(has(flags, n), n) for n in FLAGS)), lambda x: x.isNotNull())
