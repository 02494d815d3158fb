"""Search: markers, inverted index, chance rates, screen, two rankings, interleaving and top n."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import SearchParams
from ..plans.schemas import parsed
from ..plans.store import numbered, settled
from .kernels import counted_lists, map_lists, packed_lists, unpacked_lists

#: References whose sizes and backgrounds (8 bytes each) a screen looks up by number.
HELD_REFS = 1 << 21
#: Rows of (genome, numbers) or hashes that a broadcast may have; more are joined by shuffle.
SENT_ROWS = 500_000
RATES, BACKGROUND = parsed("genome string, lam double"), parsed("genome string, background float")
RANKED = parsed("q string, rid int, shared bigint, excess float, cont float, query_markers bigint, ref_markers bigint, rank int")


def markers(seeds: DataFrame) -> DataFrame:
    """genome, hash32: distinct marker hashes."""
    return seeds.select("genome", "hash32").dropDuplicates()


def numbered_refs(genomes: DataFrame, marks: DataFrame, batch_refs: int = 0) -> DataFrame:
    """genome, rid (place in the sorted list), n_markers, batch: all references, also those without markers."""
    sizes = marks.groupBy("genome").agg(F.count("*").alias("n_markers"))
    rows = genomes.select("genome").distinct().join(sizes, "genome", "left").fillna({"n_markers": 0})
    rows = numbered(rows, "genome", "rid")
    return rows.withColumn("batch", F.floor(F.col("rid") / batch_refs) if batch_refs > 0 else F.lit(0).cast("bigint"))


def background_sample(refs: DataFrame, most: int = 256) -> DataFrame:
    """k, genome, n_markers of at most ``most`` evenly spaced references."""
    total = refs.agg(F.count("*").alias("nr"))
    sized = refs.join(F.broadcast(total), F.lit(True)).withColumn("ns", F.least("nr", F.lit(most)))
    # the k whose place is rid: the inverse of rid = (k * nr + nr div 2) div ns
    k = F.expr("(rid * ns - nr div 2 + nr - 1) div nr")
    rows = sized.withColumn("k", F.greatest(k, F.lit(0)))
    return rows.where((F.col("k") < F.col("ns")) & (F.expr("(k * nr + nr div 2) div ns") == F.col("rid"))).select("k", "genome", "n_markers")


def _sample(sample: DataFrame) -> list[tuple]:
    """(k, genome, n_markers) of a background sample by k, which counts its places from 0; at most a few hundred rows."""
    return sorted((r["k"], r["genome"], r["n_markers"]) for r in sample.select("k", "genome", "n_markers").collect())


def _sent(df: DataFrame) -> DataFrame:
    """A settled table, to be broadcast if it is small. Left to itself, the engine finds out after the other side's shuffle."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _shared_with(marks: DataFrame, sample: DataFrame, sample_marks: DataFrame, size: int) -> DataFrame:
    """genome, shared: how many of its markers each sample holds, in parts to be summed. A marker is one row, however many hold it."""
    holders = sample_marks.join(F.broadcast(sample.select("genome", F.col("k").cast("int").alias("k"))), "genome").groupBy("hash32").agg(F.collect_list("k").alias("k"))
    holders = settled(packed_lists(holders, ["k"], "shared"), "holders")
    return counted_lists(marks.join(_sent(holders), "hash32").select("genome", "shared"), size)


def _summed(halves: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return unpacked_lists(halves, counts, 1)[0].reshape(-1, size).sum(axis=0) if len(halves) else np.zeros(size, np.int64)


def _given(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows (key, packed numbers) with a row of the key's values ahead of them, for map_lists."""
    key, numbers = rows.columns
    extra = [c for c in values.columns if c != key]
    empty = rows.select(key, *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in extra], numbers)
    return empty.unionByName(values.withColumn(numbers, F.lit(b"")))


def chance_rates(marks: DataFrame, names: DataFrame, sample: DataFrame, sample_marks: DataFrame) -> DataFrame:
    """genome, lam: upper median over the samples of other name of the share of their markers that the genome has."""
    drawn = _sample(sample)
    size = np.array([n for _, _, n in drawn], np.int64)
    place = {g: k for k, g, _ in drawn}

    def rate(genome, _, halves, counts):
        other = size > 0
        if genome in place:
            other[place[genome]] = False
        share = np.sort(_summed(halves, counts, len(size))[other] / size[other])
        yield genome, float(share[len(share) // 2]) if len(share) else 0.0

    return map_lists(_given(_shared_with(marks, sample, sample_marks, len(size)), names.select("genome", F.lit(True).alias("named"))), rate, RATES)


def capped_postings(marks: DataFrame, refs: DataFrame, max_posting: int) -> tuple[DataFrame, DataFrame]:
    """genome, hash32, batch of the postings of hashes that no more than max_posting references of a batch hold; and (batch, hash32)
    of those that more hold."""
    rows = marks.join(_sent(refs.select("genome", "batch")), "genome")
    crowded = settled(rows.groupBy("batch", "hash32").agg(F.count("*").alias("n")).where(F.col("n") > max_posting).select("batch", "hash32"), "crowded")
    return rows.join(_sent(crowded), ["batch", "hash32"], "left_anti"), crowded


def uncrowded(marks: DataFrame, refs: DataFrame, crowded: DataFrame) -> DataFrame:
    """Markers of queries but for those crowded in every batch, which no posting is left of."""
    batches = refs.agg(F.count_distinct("batch")).first()[0]
    gone = settled(crowded.groupBy("hash32").agg(F.count("*").alias("n")).where(F.col("n") == batches).select("hash32"), "crowded")
    return marks.join(_sent(gone), "hash32", "left_anti")


def ref_background(postings: DataFrame, refs: DataFrame, sample: DataFrame, sample_marks: DataFrame, sample_rates: DataFrame) -> DataFrame:
    """genome, background: upper median over samples of other name of their excess containment. The sample is at most 256 rows."""
    drawn = _sample(sample)
    rates = {r["genome"]: r["lam"] for r in sample_rates.collect()}
    size, lam = np.array([n for _, _, n in drawn], np.int64), np.array([rates[g] for _, g, _ in drawn])
    place = {g: k for k, g, _ in drawn}

    def middle(genome, values, halves, counts):
        own = values[0]
        shared, least = _summed(halves, counts, len(size)), np.minimum(size, own)
        value = np.where(least > 0, (shared - lam * own) / np.maximum(least, 1), 0.0).astype(np.float32)
        if genome in place:
            value = np.delete(value, place[genome])
        yield genome, float(np.sort(value)[len(value) // 2]) if len(value) else 0.0

    # references that share nothing with any sample have a background too
    return map_lists(_given(_shared_with(postings, sample, sample_marks, len(size)), refs.select("genome", "n_markers")), middle, BACKGROUND)


def ranked_candidates(query_marks: DataFrame, query_sizes: DataFrame, postings: DataFrame, refs: DataFrame, rates: DataFrame, background: DataFrame, k: int, exclude_self: bool = False, held: int = HELD_REFS) -> DataFrame:
    """q, r, rid, shared, excess, cont, query_markers, ref_markers, rank from 1: references that share more markers with a query
    than chance explains, the k first of two rankings interleaved (excess first), each reference once.

    A marker's references travel as one list to each query that holds it, and pairs are formed and ranked within a query's run.
    References' sizes and backgrounds are looked up by number, of more than ``held`` references they travel with the lists.
    """
    known = settled(refs.join(background, "genome").select("genome", "batch", F.col("rid").cast("int").alias("rid"), F.col("n_markers").cast("int").alias("n_markers"), F.col("background").cast("float").alias("background")), "refs")
    few = known.count() <= held
    if few:
        table = known.select("rid", "n_markers", "background").toPandas().sort_values("rid")
        ref_size, ref_back = table["n_markers"].to_numpy(np.int32), table["background"].to_numpy(np.float32)
    parts = ["rid"] if few else ["rid", "n_markers", "background"]
    held_by = postings.select("genome", "hash32").join(_sent(known), "genome").groupBy("batch", "hash32").agg(*[F.collect_list(c).alias(c) for c in parts])
    lists = query_marks.select(F.col("genome").alias("q"), "hash32").join(packed_lists(held_by, parts, "refs"), "hash32").select("q", "refs")
    asked = query_sizes.select(F.col("genome").alias("q"), F.col("n_markers").cast("bigint").alias("query_markers")).join(rates.select(F.col("genome").alias("q"), "lam"), "q")
    asked = asked.join(known.select(F.col("genome").alias("q"), F.col("rid").alias("itself")), "q", "left") if exclude_self else asked.withColumn("itself", F.lit(None).cast("int"))

    def first(score: np.ndarray) -> np.ndarray:
        """Places of the k largest, ties in order."""
        if len(score) <= k:
            return np.argsort(-score, kind="stable")
        least = np.partition(score, len(score) - k)[len(score) - k]
        above, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
        some = np.concatenate([above, level[: k - len(above)]])
        return some[np.lexsort((some, -score[some]))]

    def rank(q, values, halves, counts):
        n_query, lam, itself = values
        lists = unpacked_lists(halves, counts, len(parts))
        if few:
            found = np.sort(lists[0])
            begin = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            rid, shared = found[begin], np.diff(np.append(begin, len(found)))
            size, back = ref_size[rid].astype(np.int64), ref_back[rid]
        else:
            rid, at, shared = np.unique(lists[0], return_index=True, return_counts=True)
            size, back = lists[1][at].astype(np.int64), lists[2][at].view(np.float32)
        x = shared - lam * size
        ok = x > 0
        if itself is not None:
            ok &= rid != itself
        rid, shared, size, back, x = rid[ok], shared[ok], size[ok], back[ok], x[ok]
        excess, cont = x.astype(np.float32), (x / np.minimum(n_query, size) - back.astype(np.float64)).astype(np.float32)
        turns: dict[int, int] = {}
        for turn, score in enumerate((excess, cont)):
            for place, i in enumerate(first(score).tolist(), 1):
                turns[i] = min(turns.get(i, 2 * place + turn), 2 * place + turn)
        for number, i in enumerate(sorted(turns, key=turns.get)[:k], 1):
            yield q, int(rid[i]), int(shared[i]), float(excess[i]), float(cont[i]), n_query, int(size[i]), number

    found = map_lists(_given(lists, asked), rank, RANKED)
    names = known.select("rid", F.col("genome").alias("r"))
    return found.join(names, "rid").select("q", "r", F.col("rid").cast("bigint").alias("rid"), "shared", "excess", "cont", "query_markers", "ref_markers", "rank")


def candidates(query_genomes: DataFrame, query_marks: DataFrame, ref_genomes: DataFrame, ref_marks: DataFrame, params: SearchParams) -> DataFrame:
    """All of the above: ranked candidates of every query."""
    refs = settled(numbered_refs(ref_genomes, ref_marks, params.batch_refs), "refs")
    sample = settled(background_sample(refs, params.background), "sample")
    sample_marks = settled(ref_marks.join(F.broadcast(sample.select("genome")), "genome", "left_semi"), "sample")
    sizes = query_marks.groupBy("genome").agg(F.count("*").alias("n_markers"))
    rates = chance_rates(query_marks, query_genomes, sample, sample_marks)
    own_rates = chance_rates(sample_marks, sample, sample, sample_marks)
    postings, crowded = capped_postings(ref_marks, refs, params.max_posting)
    postings = settled(postings, "postings")
    back = ref_background(postings, refs, sample, sample_marks, own_rates)
    return ranked_candidates(uncrowded(query_marks, refs, crowded), sizes, postings, refs, rates, back, max(params.candidates, params.top), params.exclude_self)


def containment_result(ranked: DataFrame, top: int) -> DataFrame:
    """The first ``top`` candidates of each query, without alignment."""
    c = F.col
    return ranked.where(c("rank") <= top).select(c("q").alias("query"), c("r").alias("ref"), c("shared").alias("shared_markers"), c("excess").cast("double").alias("marker_excess"), c("cont").cast("double").alias("marker_containment"), "query_markers", "ref_markers")


def search_result(ranked: DataFrame, dist: DataFrame, top: int) -> DataFrame:
    """The ``top`` aligned candidates of each query by composite score; ties go to the lower name."""
    names = ranked.select(F.col("q").alias("query"), F.col("r").alias("ref"), F.col("shared").alias("shared_markers"), F.col("excess").cast("double").alias("marker_excess"), F.col("cont").cast("double").alias("marker_containment"))
    rows = names.join(dist, ["query", "ref"])
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("composite_score").desc(), "ref"))
    return rows.withColumn("place", place).where(F.col("place") <= top).drop("place")
