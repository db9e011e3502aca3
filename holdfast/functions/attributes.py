"""Extended attributes and access lists stored as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XATTR = "encoding string, data map<string,string>"
ACL = "map<string,int>"
_QUALIFIER = r"^(undefined(-[0-9]+)?|user-obj|group-obj|other|mask|(user|group):[0-9]+)$"


def xattrs(json: Column) -> Column:
    """Attribute map, keys and values decoded; null if the JSON has another shape or further fields."""
    parsed = F.from_json(json, XATTR)
    known = F.size(F.array_except(F.json_object_keys(json), F.array(F.lit("encoding"), F.lit("data")))) == 0
    plain = F.transform_values
    decode = lambda x: F.unbase64(x).cast("string")
    decoded = F.map_from_entries(F.transform(F.map_entries(parsed["data"]), lambda e: F.struct(decode(e["key"]), decode(e["value"]))))
    return F.when(known & (parsed["encoding"] == "base64"), decoded).when(known & (parsed["encoding"] == "utf8"), plain(parsed["data"], lambda k, v: v))


def dump_xattrs(attributes: Column) -> Column:
    """JSON with base64 keys and values."""
    code = lambda x: F.base64(x.cast("binary"))
    data = F.map_from_entries(F.transform(F.map_entries(attributes), lambda e: F.struct(code(e["key"]), code(e["value"]))))
    return F.to_json(F.struct(F.lit("base64").alias("encoding"), data.alias("data")))


def acl(json: Column) -> Column:
    """Permission bits by qualifier; null if a qualifier is malformed."""
    parsed = F.from_json(json, ACL)
    return F.when(F.forall(F.map_keys(parsed), lambda k: k.rlike(_QUALIFIER)), parsed)


def acl_entries(json: Column) -> Column:
    """array(struct(kind, identifier, permissions)) of an access list, by qualifier."""
    entry = lambda e: F.struct(F.split(e["key"], ":")[0].alias("kind"), F.get(F.split(e["key"], ":"), F.lit(1)).cast("long").alias("identifier"), e["value"].alias("permissions"))
    return F.transform(F.array_sort(F.map_entries(acl(json))), entry)
