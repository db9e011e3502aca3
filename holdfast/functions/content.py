"""Content ids: digest, size and id of a canonical file as a member name.

``{base64url(sha1)}.{base64url(size)}.{base64url(id)}{ext}``, integers as eight little-endian bytes, no
padding: 27 + 1 + 11 + 1 + 11 characters and the extension. A missing digest is 27 semicolons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DIGEST = ";" * 27
SPARSE = "sp."
LENGTH = 51


def _url(value: Column) -> Column:
    return F.translate(F.rtrim(F.base64(value), F.lit("=")), "+/", "-_")


def _little(value: Column) -> Column:
    """Eight little-endian bytes as hex."""
    big = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2)))


def encode(sha1: Column, size: Column, id: Column, ext: Column) -> Column:
    digest = F.coalesce(_url(F.unhex(sha1)), F.lit(NO_DIGEST))
    return F.concat(digest, F.lit("."), _url(F.unhex(_little(size))), F.lit("."), _url(F.unhex(_little(id))), ext)


def content_id(files=None) -> Column:
    """Of a catalog row; null unless it is a canonical regular file."""
    return F.when((F.col("canonical_id") == F.col("id")) & (F.col("ftype") == "file"), encode(F.col("sha1"), F.col("size"), F.col("id"), F.col("ext")))


def member_name() -> Column:
    """The content id, led by ``sp.`` where the stored copy is sparse."""
    return F.when(F.col("flags").bitwiseAND(F.lit(4)) != 0, F.concat(F.lit(SPARSE), content_id())).otherwise(content_id())


def _raw(part: Column) -> Column:
    """Bytes of unpadded base64url as hex. The decoder skips foreign characters, so they are mapped and padded first."""
    return F.hex(F.unbase64(F.rpad(F.translate(part, "-_", "+/"), F.lit(4) * F.ceil(F.length(part) / 4), F.lit("="))))


def _long(part: Column) -> Column:
    little = _raw(part)
    big = F.concat(*(F.substring(little, i, 2) for i in range(15, 0, -2)))
    high, low = F.conv(F.substring(big, 1, 8), 16, 10).cast("long"), F.conv(F.substring(big, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def parse(name: Column) -> Column:
    """struct(sha1, size, id, ext, sparse) of a member name, null if it is none."""
    sparse = name.startswith(SPARSE)
    own = F.when(sparse, F.substring(name, F.lit(len(SPARSE) + 1), F.length(name))).otherwise(name)
    ok = own.rlike(r"^([A-Za-z0-9_-]{27}|;{27})\.[A-Za-z0-9_-]{11}\.[A-Za-z0-9_-]{11}(\..+)?$")
    digest = F.substring(own, 1, 27)
    return F.when(
        ok,
        F.struct(
            F.when(digest != NO_DIGEST, F.lower(_raw(digest))).alias("sha1"),
            _long(F.substring(own, 29, 11)).alias("size"),
            _long(F.substring(own, 41, 11)).alias("id"),
            F.substring(own, F.lit(LENGTH + 1), F.length(own)).alias("ext"),
            sparse.alias("sparse"),
        ),
    )
