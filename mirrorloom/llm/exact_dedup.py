"""Exact deduplication by a tree-merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Tasks deal their rows to so many runs; a power of two, as each round halves them.
RUNS = 16
_KEY = ["_sha", "_check", "_bytes"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, SHA-256, and what verifies it (a second hash and the length)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.xxhash64(text).alias("_check"),
        F.octet_length(text).alias("_bytes"),
    )


def merge_runs(digests: DataFrame, runs: int = RUNS) -> DataFrame:
    """Merge sorted runs in binomial rounds: in round k the runs that differ in bit k only meet and become one.

    A run is what a task read, sorted by digest; it holds one row per digest: the identifier that stays so far
    and the number of documents. In a round each task sorts and reduces its rows, partners exchange them
    (each run in slices by digest, so no task holds a whole one), and the sorted
    slices that arrive are merged in their order. The greatest identifier is kept in a struct, whose
    aggregate Spark only evaluates over sorted rows: there is no hash table at any level. A group of copies
    of any size is one row of each task before the first exchange, and at most ``runs`` rows after it.
    The verification columns are part of the key at every level: digests that agree while they differ stay apart.
    """
    if runs < 2 or runs & runs - 1:
        raise ValueError("runs must be a power of two")
    own = F.pmod(F.spark_partition_id(), F.lit(runs))
    level = digests.select(*_KEY, own.alias("_run"), F.struct(F.col("_id").alias("id")).alias("_keep"), F.lit(1).cast("long").alias("_size"))
    while runs > 1:
        runs //= 2
        level = level.groupBy(*_KEY, F.shiftright("_run", 1).alias("_run")).agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    return level.select(*_KEY, F.col("_keep.id").alias("_keep"), "_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as the empty text. The row with
    the largest identifier stays; a null identifier is less than any other. Of rows that
    repeat an identifier with the same text each is ``kept`` (use ``dedup`` to keep one).
    An empty table gives an empty result. Only the two named columns are read, so other
    columns may have any names.
    """
    digests = materialize(digest_runs(docs, id_col, text_col), "digests")
    merged = materialize(merge_runs(digests), "merged")
    joined = digests.join(merged, _KEY, "left")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat both identifier and text leave one row. The rows are matched by
    identifier and digest, which no group of copies shares, so no key is hot.
    """
    digests = materialize(digest_runs(docs, id_col, text_col), "digests")
    own, stay_id, stay_sha = fresh(docs, "own_sha", "stay_id", "stay_sha")
    stays = merge_runs(digests).select(F.col("_keep").alias(stay_id), F.col("_sha").alias(stay_sha))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tagged = docs.withColumn(own, F.unhex(F.sha2(text, 256)))
    left = tagged.join(stays, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_sha)), "left_semi")
    repeated = digests.groupBy("_id", "_sha").count().filter("count > 1")
    if repeated.limit(1).count():
        left = left.dropDuplicates([id_col, own])
    return left.select(*[f"`{c}`" for c in docs.columns])
