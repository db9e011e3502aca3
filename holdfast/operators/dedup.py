"""Election of canonical rows.

Where no comparison can fail, the rounds of pairwise comparison collapse to one grouped minimum per
content class. :func:`elect_by_rounds` keeps the rounds, for groups in which reading a side may fail: a round
compares all that waits in a group with one canonical, so a group whose digests tell the truth takes one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .predicates import in_phase, is_file
from .transitions import set_canonical, set_flags, skip_missing_digests, skip_non_files


def elect(rows: DataFrame, keys: tuple[str, ...] = ("sha1", "size"), keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows(id, *keys)`` -> (id, canonical_id, *keep): the smallest id of rows with equal keys.

    A grouped minimum with map-side combining and a join back, not a window: a group that holds a third of
    all rows (empty files) is summed before it moves, and the join splits it. Rows with a null key elect
    themselves; they are equal to nothing."""
    own = rows.select("id", *dict.fromkeys([*keys, *keep]))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = own.where(whole).groupBy(*keys).agg(F.min("id").alias("canonical_id"))
    return own.where(whole).join(first, list(keys)).select("id", "canonical_id", *keep).unionByName(own.where(~whole).select("id", F.col("id").alias("canonical_id"), *keep))


def dedup(files: DataFrame, content: DataFrame | None = None, singletons_canonical: bool = True) -> DataFrame:
    """The deduplication step: filtered rows become deduped with their canonical.

    content: ``(id, content)`` for verified equality, else digest and size decide. With
    ``singletons_canonical=False`` rows without a copy stay without canonical."""
    files = skip_missing_digests(skip_non_files(files))
    waiting = files.where(in_phase("filtered") & is_file())
    keys: tuple[str, ...] = ("sha1", "size")
    if content is not None:
        waiting, keys = waiting.join(content.select("id", "content"), "id", "left"), ("sha1", "size", "content")
    elected = elect(waiting, keys)
    if not singletons_canonical:
        group = elected.groupBy("canonical_id").agg(F.count("*").alias("n"))
        elected = elected.join(group, "canonical_id").select("id", F.when(F.col("n") > 1, F.col("canonical_id")).alias("canonical_id"))
    return set_canonical(files, elected)


def content_groups(rows: DataFrame) -> DataFrame:
    """(sha1, size, n, n_contents) of the groups of several rows of ``rows(id, sha1, size, content)``:
    n_contents is the number of rounds that pairwise comparison would take."""
    return rows.where("sha1 is not null").groupBy("sha1", "size").agg(F.count("*").alias("n"), F.count_distinct("content").alias("n_contents")).where("n > 1")


def elect_by_rounds(rows: DataFrame, compare: Callable[[DataFrame], DataFrame], fail_fast: bool = False) -> DataFrame:
    """(id, canonical_id, error) of ``rows(id, sha1, size, ...)``, no key null.

    A round elects each group's smallest id without error and compares it with the other waiting rows of
    the group: ``compare`` takes (canonical, candidate, the candidate's further columns, the canonical's with
    ``__`` before) and gives (canonical, candidate, equal, side), side being the id whose reading failed. Equal
    content follows the canonical, a failing comparison marks its side. The canonical is settled even if it
    failed meanwhile; a group without electable rows is settled without canonical. With ``fail_fast`` rows with
    an error are not compared again. Each round is cut by checkpoints; there are as many as the largest number
    of contents and failures of a group."""
    others = [c for c in rows.columns if c not in ("id", "sha1", "size")]
    waiting = checkpointed(rows.withColumn("error", F.lit(False)))
    settled = None
    while waiting.limit(1).count():
        canon = waiting.where("not error").groupBy("sha1", "size").agg(F.min("id").alias("canon"))
        held = waiting.join(canon, ["sha1", "size"], "left")
        head = held.where("id = canon").select("canon", *(F.col(c).alias(f"__{c}") for c in others))
        asked = held.where((F.col("id") != F.col("canon")) & (~F.col("error") if fail_fast else F.lit(True))).join(head, "canon")
        judged = checkpointed(compare(asked.select(F.col("canon").alias("canonical"), F.col("id").alias("candidate"), *others, *(f"__{c}" for c in others))))
        marked = judged.where("side is not null").select(F.col("side").alias("id")).distinct().withColumn("__marked", F.lit(True))
        equal = judged.where("equal").select(F.col("candidate").alias("id"), F.lit(True).alias("__equal"))
        error = F.col("error") | F.coalesce("__marked", F.lit(False))
        leave = F.coalesce("__equal", F.lit(False)) | F.col("canon").isNull() | (F.col("id") == F.col("canon"))
        after = checkpointed(held.join(marked, "id", "left").join(equal, "id", "left").select("id", "sha1", "size", *others, "canon", error.alias("error"), leave.alias("__leave")))
        done = after.where("__leave").select("id", F.col("canon").alias("canonical_id"), "error")
        settled = done if settled is None else settled.unionByName(done)
        waiting = after.where("not __leave").select(*rows.columns, "error")
    return settled if settled is not None else rows.select("id", F.lit(None).cast("long").alias("canonical_id"), F.lit(False).alias("error")).limit(0)


def elect_with_errors(rows: DataFrame, failures: DataFrame, fail_fast: bool = False) -> DataFrame:
    """(id, canonical_id, error) of ``rows(id, sha1, size, content)``; ``failures(canonical, candidate, side)``:
    comparisons that fail, and the id whose side failed. Groups without a failure are elected at once."""
    failing = failures.select(F.col("canonical").alias("__c"), F.col("candidate").alias("__d"), F.col("side").alias("__s")).distinct()
    touched = rows.join(failing.select(F.explode(F.array("__c", "__d")).alias("id")).distinct(), "id", "left_semi").select("sha1", "size").distinct()
    rows = rows.select("id", "sha1", "size", "content")

    def compare(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(failing, (F.col("canonical") == F.col("__c")) & (F.col("candidate") == F.col("__d")), "left")
        equal = F.coalesce(F.col("__s").isNull() & (F.col("content") == F.col("__content")), F.lit(False))
        return joined.select("canonical", "candidate", equal.alias("equal"), F.col("__s").alias("side"))

    plain = elect(rows.join(touched, ["sha1", "size"], "left_anti"), ("sha1", "size", "content")).withColumn("error", F.lit(False))
    return plain.unionByName(elect_by_rounds(rows.join(touched, ["sha1", "size"], "left_semi"), compare, fail_fast))


def dedup_files(files: DataFrame, paths: DataFrame, compare: Callable[[DataFrame], DataFrame], fail_fast: bool = False) -> DataFrame:
    """The deduplication step with equal digests verified by ``compare`` over ``paths(id, path)``: rows whose
    reading failed get the error flag; what differs in spite of its digest gets a canonical of its own."""
    files = skip_missing_digests(skip_non_files(files))
    waiting = files.where(in_phase("filtered") & is_file()).select("id", "sha1", "size").join(paths.select("id", "path"), "id")
    several = waiting.groupBy("sha1", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alone = waiting.join(several, ["sha1", "size"], "left_anti").select("id", F.col("id").alias("canonical_id"), F.lit(False).alias("error"))
    elected = alone.unionByName(elect_by_rounds(waiting.join(several, ["sha1", "size"], "left_semi"), compare, fail_fast))
    return set_flags(set_canonical(files, elected), elected.where("error"), "dedup_error")
