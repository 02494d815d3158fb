"""Chat formatting with cumulative-snapshot collapse.

Logs that save a conversation after every turn hold many conversations that are prefixes of longer ones. Every turn is hashed with its
place; the running sum of the two 64-bit hashes is the hash of the prefix that ends there. A conversation whose whole hash is a
prefix hash of a longer one is dropped by an anti-join, of equal conversations the lowest conv_id stays, and the rest are rendered.

Running sums are taken in blocks of ``BLOCK`` turns and then over the blocks, and a conversation is rendered in
parts of that many turns, so that one very long conversation isn't the work of one task.

Defined results: turns are ordered by turn (null last), role and text; a null role is "unknown", a null text empty; rows without a conv_id are
one conversation, which ranks first; repeated rows are turns of their own; "<|" in a text becomes "< |", so that no text can end a turn; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 256


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 1), n (turns), role, text, h1 and h2 (hash of the prefix that ends here)."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.lower(F.trim("role")), F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long").alias("block"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("turns"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    before = blocks.withColumn("turns_before", F.coalesce(F.sum("turns").over(over), F.lit(0).cast("long"))).withColumn("n", F.sum("turns").over(whole))
    same = F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.block") == F.col("b.block"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("k", F.row_number().over(inside))
    out = rows.alias("r").join(before.alias("b"), same).select("r.conv_id", "r.block", "r.role", "r.text", (F.col("turns_before") + F.col("k")).alias("pos"), "n")
    hashed = [F.xxhash64(F.lit(seed), "pos", "role", "text").cast("decimal(38,0)").alias(f"x{seed}") for seed in (1, 2)]
    out = materialize(out.select("*", *hashed), "chat-turns")
    sums = out.groupBy("conv_id", "block").agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.withColumns({f"b{i}": F.coalesce(F.sum(f"s{i}").over(over), zero) for i in (1, 2)}).drop("s1", "s2")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = out.withColumns({f"run{i}": F.sum(f"x{i}").over(upto) for i in (1, 2)})
    both = runs.alias("r").join(sums.alias("b"), same)
    return both.select("r.conv_id", "r.block", "role", "text", "pos", "n", *[(F.col(f"run{i}") + F.col(f"b{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n of the conversations that aren't a prefix of a longer one or equal to one of a lower conv_id.

    Equal conversations, and equal prefixes, are combined before the anti-join, so that a very common one is a row a task there.
    """
    # nulls rank first: whether there is one decides before the least id does
    least = F.min(F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id")).alias("first")
    ends = turns.where("pos = n").groupBy("n", "h1", "h2").agg(least, F.count("*").alias("n_equal"))
    longer = turns.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(longer, ["n", "h1", "h2"], "left_anti").select("first.conv_id", "n", "n_equal")


def chat_texts(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation and part: conv_id, part, n_turns (of the conversation), n_equal, text."""
    turns = materialize(numbered(conversations), "chat-hashes")
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id").select("kept_id", "n_equal")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    said = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
    whole = rows.select("conv_id", part.alias("part"), "n", "n_equal", F.struct("pos", said.alias("said")).alias("t"))
    texts = whole.groupBy("conv_id", "part", "n", "n_equal").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return texts.select("conv_id", "part", F.col("n").alias("n_turns"), "n_equal", F.array_join("ts.said", "").alias("text"))
