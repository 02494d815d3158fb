"""Substring deduplication by line hashing, and of every repeated run of ``WINDOW`` words within lines.

Three kinds of units go. Whole texts that an earlier doc_id has already go first. Lines of ``WINDOW`` words, or of ``LONG`` code points whatever their words, are normalised, hashed and grouped as in
``substrings``. That can't see a passage inside a longer line, or one that is broken otherwise; so of equal runs of ``WINDOW`` words
(A-Z lower-cased, whatever blanks lie between, line ends too) the earliest stays as well, in order of doc_id, then place, and the others
are removed. In scripts without blanks each letter counts as a word. Only runs that hold a repeated anchor are compared: the anchor is the
least hash of the ``GRAM``-word runs in it, which equal runs share, so that none is missed. Shorter lines and runs, however common, stay: stock phrases
aren't passages. Spans are code points of the original text, end exclusive, merged where they overlap; the text is what they leave.

Defined results: null text is empty and stays null; null doc_ids rank first; rows equal in doc_id and text are one document, with the same
result for each; where a run overlaps its own first occurrence, the first occurrence stays whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import substrings
from .common import join_repeated, materialize, tidy

WINDOW = 50
#: Code points, blanks apart, that make a line a unit where it has few words: tables, code, unbroken runs.
LONG = 400
GRAM = 26
#: Lists of documents are broadcast up to this many (with spans: up to four times as many of both); longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Thai to Lao, Burmese, Khmer, kana, Han: first and last code points.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
ROWS = 50_000
#: Texts that are sent to a kernel at once: those with repeated anchors are long, and come with their lists of anchors.
TEXTS = 500


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of a text's words."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ink = (c != 32) & ((c < 9) | (c > 13))
    if not ink.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    if c.max() >= UNSPACED[0][0]:
        own = np.zeros(len(c), bool)
        for a, b in UNSPACED:
            own |= (c >= a) & (c <= b)
        own &= ink
        first |= own
        last |= own
        first[1:] |= own[:-1] & ink[1:]
        last[:-1] |= own[1:] & ink[:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    letters = c[ink].astype(np.uint64)
    letters += np.uint64(32) * ((letters >= 65) & (letters <= 90)).astype(np.uint64)
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    place = (np.arange(len(letters)) - np.repeat(offsets, sizes)).astype(np.uint64)
    return starts, ends, mixed(np.add.reduceat(mixed(letters + (place << np.uint64(21)) + np.uint64(1)), offsets))


_held: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64; those of usual texts are kept."""
    out = _held.get(base)
    if out is None or len(out) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n <= 1 << 18:
            _held[base] = out
    return out[:n]


def runs(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of so many words."""
    room = 1 << max(10, len(hashes).bit_length())
    up, down = powers(base, room), powers(pow(base, -1, 1 << 64), room)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1])


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all GRAM-word runs, and the least of them in each WINDOW-word run."""
    grams = runs(hashes, GRAM, _BASES[0])
    least, width, wanted = grams, 1, WINDOW - GRAM + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return grams, np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])


def _emitted(source: DataFrame, fields: list[T.StructField], found) -> DataFrame:
    """doc_id and h of source's rows (doc_id, h, text, arrays) beside the columns that found(text, *arrays) gives as arrays."""
    schema = T.StructType([source.schema["doc_id"], T.StructField("h", T.LongType()), *fields])

    def emit(batches):
        for batch in batches:
            at, held, n = [], [[] for _ in fields], 0
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py() or ""
                columns = found(text, *(c[i].values for c in batch.columns[3:])) if len(text) >= WINDOW else None
                if columns is not None and len(columns[0]):
                    at.append(np.full(len(columns[0]), i))
                    for c, v in zip(held, columns, strict=True):
                        c.append(v)
                    n += len(columns[0])
                if n >= ROWS or (n and i == batch.num_rows - 1):
                    rows = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(np.concatenate(c)) for c in held)], names=schema.names)
                    at, held, n = [], [[] for _ in fields], 0

    return source.mapInArrow(emit, schema)


def _own_anchors(text):
    hashes = words(text)[2]
    if len(hashes) < WINDOW:
        return None
    grams, least = anchors(hashes)
    values, counts = np.unique(grams, return_counts=True)
    used = np.unique(least)
    return used.view(np.int64), np.minimum(counts[np.searchsorted(values, used)], 2).astype(np.int64)


def _own_runs(text, repeated, lost):
    starts, ends, hashes = words(text)
    least = anchors(hashes)[1]
    wanted = np.isin(least.view(np.int64), repeated.to_numpy())
    if lost is not None and len(lost):
        # a run inside one lost line goes with it; the line's earlier copy has the run too
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
        first, last = (np.searchsorted(breaks, x) for x in (starts[: len(least)], starts[WINDOW - 1 :]))
        wanted &= (first != last) | ~np.isin(first, lost.to_numpy())
    at = np.flatnonzero(wanted)
    digests = (runs(hashes, WINDOW, _BASES[1])[at], runs(mixed(hashes + np.uint64(1)), WINDOW, _BASES[0])[at])
    return starts[at].astype(np.int32), ends[at + WINDOW - 1].astype(np.int32), *(d.view(np.int64) for d in digests)


def _by_document(left: DataFrame, right: DataFrame, how: str, few: bool = False) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "s_id", "h": "s_h"})
    right = F.broadcast(right) if few else right
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), how).drop("s_id", "s_h")


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id, h of the documents whose whole text stands under an earlier doc_id."""
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")), "texts")
    kept = materialize(rows.groupBy("h", "h2").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1"), "texts-kept")
    return materialize(join_repeated(rows, kept, ["h", "h2"]).where(~F.struct("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h").distinct(), "texts-copies")


def repeated_runs(source: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, h, runs (start, end): what to remove from source's rows (doc_id, h, text) besides lines (doc_id, h, places)."""
    found = materialize(_emitted(source, [T.StructField("anchor", T.LongType()), T.StructField("n", T.LongType())], _own_anchors), "anchors", TEXTS)
    repeated = materialize(found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors-repeated")
    held = join_repeated(found.select("doc_id", "h", "anchor"), repeated, ["anchor"]).groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("further"))
    # rows are written in order: their numbers rank documents by doc_id, null first, then h
    held = materialize(_by_document(held, lines, "left").orderBy("doc_id", "h").withColumn("rank", F.monotonically_increasing_id()), "anchors-held")
    tidy(source.sparkSession)
    few = held.count() <= BROADCAST_ROWS
    some = _by_document(source, held.select("doc_id", "h"), "left_semi", few) if few else source
    rows = _by_document(some, held, "inner").select(F.col("rank").alias("doc_id"), "h", "text", "further", "places")
    fields = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("d0", T.LongType()), T.StructField("d1", T.LongType())]
    placed = materialize(_emitted(rows, fields, _own_runs).drop("h").withColumnRenamed("doc_id", "rank"), "runs", TEXTS)
    tidy(source.sparkSession)
    kept = materialize(placed.groupBy("d0", "d1").agg(F.min(F.struct("rank", "start", "end")).alias("first"), F.count("*").alias("n")).where("n > 1"), "runs-kept")
    tidy(source.sparkSession)
    same = F.col("rank") == F.col("first.rank")
    start = F.when(same, F.greatest("start", "first.end")).otherwise(F.col("start"))
    lost = join_repeated(placed, kept, ["d0", "d1"]).where(~(same & (F.col("start") == F.col("first.start")))).select("rank", start.alias("start"), "end").where("start < end")
    lost = lost.groupBy("rank").agg(F.collect_set(F.struct("start", "end")).alias("runs")).mapInArrow(_joined_up, T.StructType([T.StructField("rank", T.LongType()), T.StructField("runs", substrings.SPANS)]))
    return held.select("doc_id", "h", "rank").join(lost, "rank").drop("rank")


def _joined_up(batches):
    """Each row's spans, joined where they overlap."""
    for batch in batches:
        lists = batch.column(1)
        offsets, spans = lists.offsets.to_numpy(), lists.values
        start, end = (spans.field(k).to_numpy() for k in range(2))
        owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
        start, end = start[offsets[0] : offsets[-1]].astype(np.int64), end[offsets[0] : offsets[-1]].astype(np.int64)
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], end[order]
        # ends of different rows are kept apart by the row's number in the high bits
        top = np.maximum.accumulate((owner << 32) + end)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] << 32) + start[1:] >= top[:-1]
        at = np.flatnonzero(new)
        values = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array((np.maximum.reduceat((owner << 32) + end, at) & 0xFFFFFFFF).astype(np.int32))], names=["start", "end"])
        bounds = np.searchsorted(owner[at], np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), values)], names=["rank", "runs"])


def merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap, without leading blanks of a cut run."""
    out = []
    for a, b in sorted(spans):
        a += len(text[a:b]) - len(text[a:b].lstrip(" \t\n\v\f\r"))
        if a >= b:
            continue
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without merged spans."""
    begins, ends = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]
    return "".join(text[a:b] for a, b in zip(begins, ends, strict=True))


def without_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text (without repeated lines and runs), n_removed, removed_chars, spans (array of start and end)."""
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    lines = materialize(substrings.repeated_places(docs, min_words=WINDOW, min_chars=LONG), "passage-lines")
    copies = later_copies(docs)
    # all runs of a later copy of a whole text are repeated: the others' are looked for
    fresh = _by_document(source, copies, "left_anti", copies.count() <= BROADCAST_ROWS)
    parts = [("places", "array<int>", lines), ("runs", substrings.SPANS, repeated_runs(fresh, lines)), ("whole", "boolean", copies.withColumn("whole", F.lit(True)))]
    columns = lambda own: [F.col(n) if n == own else F.lit(None).cast(t).alias(n) for n, t, _ in parts]
    both = reduce(DataFrame.unionByName, [df.select("doc_id", "h", *columns(n)) for n, _, df in parts])
    gone = materialize(both.groupBy("doc_id", "h").agg(*[F.max(n).alias(n) for n, _, _ in parts]), "passages")
    tidy(docs.sparkSession)
    size = gone.agg(F.sum(1 + F.greatest(F.size("places"), F.lit(0)) + F.greatest(F.size("runs"), F.lit(0)))).first()[0] or 0
    both = _by_document(source, gone, "left", size <= 4 * BROADCAST_ROWS).select("doc_id", "text", *[n for n, _, _ in parts])
    schema = T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_chars", T.LongType()), T.StructField("spans", substrings.SPANS)])

    def cut(batches):
        for batch in batches:
            texts, spans = [], []
            for row in zip(*batch.columns[1:], strict=True):
                text, places, more, all_ = (x.as_py() for x in row)
                gone = [(x["start"], x["end"]) for x in more or []]
                if all_ and text:
                    begins, ends, _ = words(text)
                    gone += [(int(begins[0]), int(ends[-1]))] if len(begins) >= WINDOW else []
                if places:
                    whole = substrings.pieces(text)
                    gone += [whole[k] for k in places]
                gone = merged(text, gone) if gone else []
                texts.append(without(text, gone) if gone else text)
                spans.append(gone)
            yield substrings.span_rows(batch.column(0), texts, spans, schema)

    return both.mapInArrow(cut, schema)
