"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are kept in order of residual room and carry two bitmaps: the sources and the duplicate clusters they hold. Documents are placed
by falling size; the search starts at the bin whose residual is the least that suffices and moves on to the next larger one until a bin
shares neither source nor cluster, which is the tightest compatible bin. If there is none, a bin is opened. A document longer than a
bin fills whole bins of its own, and its rest is placed like any other.

Documents are dealt by a hash of doc_id, source and text into shards of half to all of ``SHARD_ROWS``, a power of two of them, so that more rows deal others anew only
when the shards double and the layout of the files plays no part. A shard is packed in one task, whatever sources and clusters hold; no bin spans two shards.
A cluster is a set of equal texts (A-Z folded), or what the column ``cluster`` says, such as the component_id of near duplicates.

Defined results: null text has no words; a document without words still takes a place; a null source never conflicts; null and repeated
doc_ids are placed like others, equal texts conflict; ties in size are broken by doc_id (null first), then text hash; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_az, materialize, word_count

CAPACITY = 1024
SHARD_ROWS = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, piece, bin, words) in order of placing, for items in falling order of size; None never conflicts."""
    out: list[tuple[int, int, int, int]] = []
    bits: dict = {}

    def bit(kind: str, value) -> int:
        return 0 if value is None else 1 << bits.setdefault((kind, value), len(bits))

    opened, order, held, rest = 0, [], [], []
    for i, size in enumerate(sizes):
        full = 0 if size <= capacity else size // capacity
        for piece in range(full):
            out.append((i, piece, opened, capacity))
            held.append(None)
            opened += 1
        if size - full * capacity or not full:
            rest.append((i, full, size - full * capacity))
    rest.sort(key=lambda x: (-x[2], x[0]))
    for i, piece, size in rest:
        mark = bit("s", sources[i]) | bit("c", clusters[i])
        at = bisect_left(order, (size, -1))
        while at < len(order) and held[order[at][1]] & mark:
            at += 1
        if at < len(order):
            room, home = order.pop(at)
        else:
            room, home = capacity, opened
            held.append(0)
            opened += 1
        held[home] |= mark
        insort(order, (room - size, home))
        out.append((i, piece, home, size))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """One row per placed piece: doc_id, piece, bin_id, slot, start (word in the bin), size, doc_size, source."""
    text = F.coalesce("text", F.lit(""))
    own = F.xxhash64(fold_az(text))
    items = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (F.xxhash64(cluster) if cluster else own).alias("cluster"), own.alias("own"))
    items = materialize(items, "pack-items")
    shards = 1 << max(0, math.ceil(math.log2(max(1, items.count()) / shard_rows)))
    # a copy of a row must not follow it into the same shard: equal rows are numbered, and it is all one which has which number
    same = ["doc_id", "source", "own"]
    dealt = items.withColumn("r", F.row_number().over(Window.partitionBy(*same).orderBy("size")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(*same, "r"), F.lit(shards)).cast("long")).drop("r", "own")
    schema = T.StructType([items.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("piece", T.LongType()), ("bin_id", T.LongType()), ("slot", T.IntegerType()), ("start", T.LongType()), ("size", T.LongType()),
        ("doc_size", T.LongType()), ("source", T.StringType())))])

    def place(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
        sources = [None if pd.isna(x) else x for x in shard["source"]]
        many = shard["cluster"].duplicated(keep=False)
        clusters = [c if m else None for c, m in zip(shard["cluster"], many, strict=True)]
        found = pd.DataFrame(best_fit(shard["size"].tolist(), sources, clusters, capacity), columns=["item", "piece", "bin", "size"])
        rows = shard.loc[found["item"]].reset_index(drop=True)
        room = found.groupby("bin")
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "piece": found["piece"], "bin_id": rows["shard"] * (1 << 32) + found["bin"], "slot": room.cumcount().astype("int32"),
            "start": room["size"].cumsum() - found["size"], "size": found["size"], "doc_size": rows["size"], "source": rows["source"],
        })

    return dealt.groupBy("shard").applyInPandas(place, schema)
