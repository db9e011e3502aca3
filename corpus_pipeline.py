"""A training-corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Every stage takes what its predecessor kept, whole, and returns the columns of ``documents`` (the last
one: the packing). Stages are written as Parquet in the shared folder and read again.

Defined cases, of every stage: an empty table gives an empty one; columns beyond doc_id and text are kept,
whatever their names; rows are judged one by one, so rows that repeat, or that share a doc_id, share their
fate; a null text stays null where the row stays, and counts as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, lines, packing, quality, similar
from holdfast.llm.textcore import bounded_batches, shared_dir, texts


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. A null doc_id has no label; a null or empty text is
    scored by the margin of no feature; without labels of both classes nothing or everything is rejected."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.train(docs, texts(spark, sf_dir, "labels"), ~quality.held_out()))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows; n_chars follows the text. A null doc_id ranks last; null
    texts stay null; a text may become empty, its row stays."""
    bounded_batches(spark)
    out = lines.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 of five-word shingles, found by wide signatures, then by
    prefixes. The smallest doc_id stays, with all rows of that id; rows without doc_id stay; texts without words
    are one text; ties don't arise, since the smallest id is one."""
    bounded_batches(spark)
    return similar.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark. Null and empty texts hold none; items without
    item_id count; an empty benchmark removes nothing."""
    bounded_batches(spark)
    return decontaminate.remove_contaminated(docs, texts(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens. Null and empty texts are the end id alone."""
    bounded_batches(spark)
    return packing.pack(packing.pieces(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            _remove(spark, folder)  # the packing has its pieces in a checkpoint of its own by now
            return out
        out.write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        if i:
            _remove(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Drop a stage's table once its successor's is written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
