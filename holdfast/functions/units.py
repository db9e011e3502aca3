"""Sizes, durations and labels as text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of size suffixes.
SIZE_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}
LIMIT_UNITS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}


def size_of(text: str) -> int:
    """:func:`parse_size` for one value; malformed text is an error."""
    import re

    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in SIZE_UNITS:
        raise ValueError(f"malformed size {text!r}")
    return int(Decimal(m[1]) * SIZE_UNITS[m[2].lower()] + Decimal("0.5"))


def limit_of(text: str) -> int:
    """:func:`parse_limit` for one value, percentages of this machine's memory; malformed text is an error."""
    import os
    import re

    m = re.fullmatch(r"\s*\+?([0-9]+)\s*([A-Za-z%]*)\s*", text)
    if m and m[2] == "%" and 1 <= int(m[1]) <= 100:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") * int(m[1]) // 100
    if not m or m[2] not in LIMIT_UNITS or int(m[1]) * LIMIT_UNITS[m[2]] >= 2**63:
        raise ValueError(f"malformed limit {text!r}")
    return int(m[1]) * LIMIT_UNITS[m[2]]


def _factor(unit: Column, table: dict[str, int]) -> Column:
    out = F
    for name, value in table.items():
        out = out.when(unit == name, F.lit(value).cast("long"))
    return out.otherwise(F.lit(None).cast("long"))


def parse_size(text: Column) -> Column:
    """Bytes of '4096', '1Kb' (1000), '2.5Kib' (2560), without regard to case; null if malformed."""
    s = F.trim(text)
    number, unit = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)$", 1), F.lower(F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)$", 2))
    return F.when(number != "", F.round(number.cast("decimal(20,4)") * _factor(unit, SIZE_UNITS)).cast("long"))


def parse_limit(text: Column, memory: Column | None = None) -> Column:
    """Bytes of a memory limit: whole numbers with K, M, G (decimal) or KiB, MiB, GiB, or a percentage of
    ``memory``. Null if malformed, a percentage outside 1 to 100, or beyond 64 bits."""
    s = F.trim(text)
    number, unit = F.regexp_extract(s, r"^\+?([0-9]+)\s*([A-Za-z%]*)$", 1), F.regexp_extract(s, r"^\+?([0-9]+)\s*([A-Za-z%]*)$", 2)
    value = F.when(number != "", number.cast("decimal(30,0)"))
    share = F.when(value.between(1, 100), F.floor(value * (memory if memory is not None else F.lit(None).cast("long")) / 100))
    bytes_ = value * _factor(unit, LIMIT_UNITS).cast("decimal(12,0)")
    out = F.when(unit == "%", share.cast("decimal(38,0)")).otherwise(bytes_.cast("decimal(38,0)"))
    return F.when(out < F.lit(str(2**63)).cast("decimal(38,0)"), out.cast("long"))


def format_bytes(n: Column) -> Column:
    def scaled(size: int, unit: str) -> Column:
        return F.concat(F.format_string("%.2f", F.bround(n / F.lit(float(size)), 2)), F.lit(unit))

    return F.when(n >= 1 << 30, scaled(1 << 30, "GiB")).when(n >= 1 << 20, scaled(1 << 20, "MiB")).when(n >= 1 << 10, scaled(1 << 10, "KiB")).otherwise(F.concat(n.cast("string"), F.lit("B")))


def format_mib(n: Column) -> Column:
    """Whole MiB, rounded up, thousands parted by an apostrophe."""
    mib = F.floor((n + (1 << 20) - 1) / (1 << 20)).cast("long")
    return F.concat(F.translate(F.format_number(mib, 0), ",", "'"), F.lit(" MiB"))


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minute, hour = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" seconds")))
        .when(s < 3600, F.concat(minute.cast("string"), F.lit("min"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(hour.cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("min"), two(s % 60), F.lit("s")))
    )


def format_eta(read: Column, total: Column, elapsed: Column) -> Column:
    known = (read > 0) & (total > 0) & (read < total)
    return F.when(known, format_duration(F.floor((total - read) * F.greatest(elapsed, F.lit(1e-9)) / read))).otherwise("?")


def truncate_middle(text: Column, most: int) -> Column:
    keep = max(most - 1, 0) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(keep)), F.lit("…"), F.right(text, F.lit(keep))))
