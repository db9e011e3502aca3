"""The driver's tables read as a catalog: the same rules in Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import elect
from ..schema import conform

#: Column rules over ``documents`` that both engines evaluate; {n} is the name of the byte length.
_RULES = {
    "id": "doc_id",
    "ext": "case doc_id % 3 when 0 then '' when 1 then '.txt' else '.md' end",
    "rel_path": "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc' || cast(doc_id as string) || case doc_id % 3 when 0 then '' when 1 then '.txt' else '.md' end",
    "size": "cast({n}(coalesce(text, '')) as bigint)",
    "sha1": "case when doc_id % 29 = 0 then null else sha1(coalesce(text, '')) end",
    "ftype": "case when doc_id % 11 = 0 then 'dir' when doc_id % 17 = 0 then 'symlink_file' when doc_id % 19 = 0 then null else 'file' end",
    "uid": "cast(doc_id % 27 as bigint)",
    "gid": "cast(doc_id % 7 as bigint)",
    "mode": "cast(33188 + doc_id % 8 as bigint)",
    "sparse_count": "case when doc_id % 23 = 0 then null else cast(doc_id % 5 as bigint) end",
    "phase": "case doc_id % 5 when 0 then 'filtered' when 1 then 'deduped' when 2 then 'staged' when 3 then 'archived' else 'sparsified' end",
    "flags": "cast(case when doc_id % 2 = 0 then 64 else 0 end + case when doc_id % 3 = 0 then 1 else 0 end + case when doc_id % 13 = 0 then 16 else 0 end + case when doc_id % 31 = 0 then 4 else 0 end + case when doc_id % 37 = 0 then 8 else 0 end as bigint)",
}


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without canonical ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*(f"{rule.format(n='octet_length')} as {name}" for name, rule in _RULES.items()))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog; regular files with a digest have the smallest id of their content as canonical."""
    raw = raw_files(spark, sf_dir)
    elected = elect(raw.where("ftype = 'file' and sha1 is not null"))
    return conform(raw.join(elected, "id", "left"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): the text with id % 100 zero bytes behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.unhex(F.concat(F.hex(F.coalesce("text", F.lit("")).cast("binary")), F.expr("repeat('00', cast(doc_id % 100 as int))"))).alias("content"))


#: DuckDB: ``files`` as a common table expression.
FILES = (
    "raw as (select " + ", ".join(f"{rule.format(n='strlen')} as {name}" for name, rule in _RULES.items()) + " from documents), "
    "files as (select *, case when ftype = 'file' and sha1 is not null then min(id) over (partition by sha1, size, coalesce(ftype = 'file', false)) end canonical_id from raw)"
)
