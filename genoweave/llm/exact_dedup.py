"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary (Spark's frequent-items sketch) over the digests names every digest that can be
frequent. An exact count verifies the names; the verified winners, at most ``TOP`` rows, are broadcast and
their rows are settled map-side. Only the other digests, whose groups the sketch's error bound keeps small, are
shuffled.

Defined results: null text counts as empty, so null and empty texts are equal; null doc_ids sort lowest; of fully
repeated rows exactly one stays; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_az, materialize

#: Most frequent digests that are verified and broadcast, and counters kept by a Misra-Gries summary.
TOP, TRACKED = 128, 1024
#: A verified digest is settled map-side when it has at least this many rows.
MIN_HOT = 32
#: Rows to leave out are broadcast up to this many; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Summaries are combined in this many groups before the last one.
FAN_IN = 128


def text_digest(text: str = "text") -> F.Column:
    return F.unhex(F.sha2(fold_az(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))


def frequent(rows: DataFrame, key: str, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """The keys that a Misra-Gries summary of all rows holds as most frequent: one column, at most ``top`` rows."""
    parts = rows.groupBy((F.spark_partition_id() % FAN_IN).alias("g")).agg(F.expr(f"approx_top_k_accumulate(hex({key}), {tracked})").alias("s"))
    # grouped by a constant: a partition without summaries then gives none, where a global one would give a void summary
    whole = parts.groupBy(F.lit("all").alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {top})")).alias("i")).select(F.unhex("i.item").alias(key))


def groups(rows: DataFrame) -> DataFrame:
    """rows(digest, doc_id, uid) -> rows with best (the struct of the row that stays) and group_size."""
    best = [F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("group_size")]
    named = frequent(rows, "digest")
    hot = materialize(rows.join(F.broadcast(named), "digest").groupBy("digest").agg(*best).where(F.col("group_size") >= MIN_HOT), "dedup-hot")
    settled = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return settled.unionByName(rest.join(rest.groupBy("digest").agg(*best), "digest"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays."""
    rows = materialize(docs.select(F.col("doc_id"), text_digest().alias("digest")).withColumn("uid", F.monotonically_increasing_id()), "dedup-rows")
    return groups(rows).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies; columns and whole texts unchanged. Texts are only shuffled when over ``BROADCAST_ROWS`` rows go."""
    rows = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("__stays"), F.count("*").alias("__n")).where("not __stays or __n > 1")
    marks = materialize(rows.select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"), "__stays"), "dedup-marks")
    few = marks.count() <= BROADCAST_ROWS
    named = docs.withColumn("__d", text_digest())
    found = named.join(F.broadcast(marks) if few else marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")), "left")
    # rows of one doc_id with equal texts: the largest text stays (they may differ in case), then the largest row
    once = Window.partitionBy("__id", "__digest").orderBy(F.col("text").desc_nulls_last(), F.xxhash64(*docs.columns))
    repeated = found.where("__stays").withColumn("__k", F.row_number().over(once)).where("__k = 1")
    return found.where("__stays is null").select(*docs.columns).unionByName(repeated.select(*docs.columns))
