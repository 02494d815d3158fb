"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Target shares start in proportion to weight. A source stops at ``max_epochs`` times its own size; the excess goes to the
others by weight until none is above its cap. That fixed point has a closed form: with sources ordered by cap per
unit of weight, the water level is the first (words left) / (weight left) that the next source can take.

A source's rate is target / size. Every document gets floor(rate) whole repetitions. The rest goes, in a seeded
order (md5 of seed and doc_id), to one further whole repetition each until the target is reached; the document that
crosses it gives the leading part that is still missing, so that a source's total is its target within one word.
The seeded order is summed in two levels (hash bucket, then the one crossing bucket), so no source is sorted in one task.

Defined results: null text has size 0; null source is a source of its own, last in order; null doc_ids sort first in
their seeded order; repeated rows are rows of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded hash that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, source_size), one row each -> with target. Windows over one row per source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    left = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    return (
        sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("words_left", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
        .withColumn("weight_left", F.sum("w").over(left))
        .withColumn("fits", F.col("words_left") * F.col("w") <= F.col("cap") * F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.struct(F.col("source").isNull().alias("n"), "source").alias("s"), "words_left", "weight_left"))).over(every))
        .withColumn("is_fit", F.coalesce(F.max("fits").over(before), F.lit(False)) | F.col("fits"))
        .withColumn("target", F.when(F.col("is_fit"), F.col("level.words_left").cast("double") * F.col("w") / F.col("level.weight_left")).otherwise(F.col("cap").cast("double")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (whole repetitions), part_words, taken."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("h")).withColumn("b", F.substring("h", 1, BUCKET_DIGITS)), "mix-rows")
    buckets = materialize(rows.groupBy("source", "b").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    in_order = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        buckets.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(in_order), F.lit(0).cast("long")))
        .alias("l").join(targets.alias("r"), same)
        .select("l.source", "b", "bucket_size", "bucket_before", "source_size", "target")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("extra", F.least(F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), F.col("source_size")))
        .withColumn("crosses", (F.col("bucket_before") < F.col("extra")) & (F.col("bucket_before") + F.col("bucket_size") > F.col("extra")))
    )
    at = materialize(at, "mix-levels")
    both = same & (F.col("l.b") == F.col("r.b"))
    found = rows.alias("l").join(at.alias("r"), both).select("doc_id", "l.source", "l.b", "h", "size", "source_size", "target", "whole", "extra", "bucket_before", "crosses")
    plain = found.where(~F.col("crosses")).withColumn("part", F.when(F.col("bucket_before") < F.col("extra"), F.col("size")).otherwise(F.lit(0).cast("long")))
    ordered = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    crossing = found.where("crosses").withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(ordered), F.lit(0).cast("long")))
    crossing = crossing.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("extra") - F.col("before")))).drop("before")
    out = plain.unionByName(crossing)
    full = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + full.cast("long")).alias("copies"),
        F.when(full, F.lit(0).cast("long")).otherwise(F.col("part")).alias("part_words"),
        (F.col("size") * F.col("whole") + F.col("part")).alias("taken"),
    )


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """docs repeated as the mix says: whole copies, and for a crossing document its leading words once."""
    plan = mix(docs, **params).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").alias("__c"), F.col("part_words").alias("__p"))
    # rows that repeat whole (same id, source and size) carry one plan row each: sum them, deal once
    plan = plan.groupBy("__id", "__s", "__z").agg(F.sum("__c").alias("__c"), F.sum("__p").alias("__p"), F.count("*").alias("__rows"))
    named = docs.withColumn("__words", word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__words") == F.col("__z"))
    turn = Window.partitionBy("__id", "__s", "__z").orderBy("text")
    found = named.join(plan, on).withColumn("__n", F.row_number().over(turn)).withColumn("__each", F.floor(F.col("__c") / F.col("__rows")) + (F.col("__n") <= F.col("__c") % F.col("__rows")).cast("long"))
    found = found.withColumn("__part", F.when(F.col("__n") == 1, F.col("__p")).otherwise(F.lit(0)).cast("int"))
    whole = found.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__each")))).where("__k > 0")
    # at most one document of a source crosses its target
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("__part")), "")
    part = found.where("__part > 0").withColumn("text", lead)
    return whole.select(*docs.columns).unionByName(part.select(*docs.columns))
