"""Moments as text by RFC 3339."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, time to the second, a fraction if there is one, and the offset or Z.
PATTERN = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def print_time(moment: Column) -> Column:
    """``2024-01-31T23:59:59.25+00:00`` in UTC: microseconds, without zeros at the end or a bare point."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    fraction = F.regexp_replace(F.date_format(utc, ".SSSSSS"), r"\.?0*$", "")
    return F.when(moment.isNotNull(), F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")))


def parse_time(text: Column) -> Column:
    """The moment of such a text, whatever its offset, to the microsecond; null if malformed or no date."""
    part = lambda k: F.regexp_extract(text, PATTERN, k)
    offset = F.when(F.upper(part(4)) == "Z", "+00:00").otherwise(part(4))
    plain = F.concat(part(1), F.lit("T"), part(2), F.rpad(F.when(part(3) == "", ".").otherwise(part(3)), 7, "0"), offset)
    return F.when(text.rlike(PATTERN), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")))
