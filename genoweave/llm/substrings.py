"""Substring deduplication by line or paragraph hashing.

A unit is a line (or a paragraph: lines up to an empty one) of at least ``MIN_WORDS`` words. Units are normalised (A-Z lower-cased, blanks
collapsed and trimmed) and hashed to 128 bits; of equal units of the whole table the earliest stays, in order of doc_id, then place,
and all others are removed. Spans are code points of the original text, end exclusive.

Defined results: null text is empty and stays null; null doc_ids rank first; rows equal in doc_id and text are one document, with
the same result for each; units with fewer words are never removed, unless ``min_chars`` is given and they have so many code points
other than blanks (scripts without blanks, long unbroken runs); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fold_az, join_repeated, materialize

MIN_WORDS = 5
_BREAKS = {"line": r"\n", "paragraph": r"\n[\x20\x09-\x0D]*\n"}
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pieces(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """Spans of a text's units; what parts two units belongs to neither."""
    out, at = [], 0
    for m in re.finditer(_BREAKS[unit], text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """doc_id, h (hash of the text), place, digest of each unit that has enough words or, where min_chars is given, code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", _BREAKS[unit], -1)).alias("place", "line"))
    # n words have 2 n - 1 code points at least: most units leave here
    lines = lines.where(F.length("line") >= min(2 * min_words - 1, min_chars or 2 * min_words))
    enough = F.regexp_count("line", F.lit(WORD)) >= min_words
    if min_chars is not None:
        enough = enough | (F.length(F.translate("line", " \t\n\v\f\r", "")) >= min_chars)
    form = F.trim(F.regexp_replace(fold_az(F.col("line")), r"[\x20\x09-\x0D]+", " "))
    return lines.where(enough).select("doc_id", "h", "place", F.unhex(F.md5(form.cast("binary"))).alias("digest"))


def repeated_places(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """doc_id, h, places: the units of each document that are removed, for documents that have some."""
    found = materialize(units(docs, unit, min_words, min_chars), "units")
    first = F.min(F.struct("doc_id", "h", "place")).alias("first")
    kept = materialize(found.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1"), "units-kept")
    lost = join_repeated(found, kept, ["digest"]).where(~F.struct("doc_id", "h", "place").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """One row per document: doc_id, text (without removed units), n_removed, removed_chars, spans (array of start and end)."""
    lost = repeated_places(docs, unit, min_words, min_chars).withColumnsRenamed({"doc_id": "s_id", "h": "s_h"})
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    both = source.join(lost, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("doc_id", "text", "places")
    schema = T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_chars", T.LongType()), T.StructField("spans", SPANS)])

    def cut(batches):
        for batch in batches:
            texts, spans = [], []
            for value, gone in zip(batch.column(1), batch.column(2), strict=True):
                text, gone = value.as_py(), gone.as_py() or []
                spans.append([])
                if gone:
                    lost, whole = set(gone), pieces(text, unit)
                    spans[-1] = [whole[k] for k in gone]
                    kept = [k for k in range(len(whole)) if k not in lost]
                    # a kept unit brings along what parted it from the unit before it
                    text = "".join(text[(whole[k - 1][1] if k and n else whole[k][0]) : whole[k][1]] for n, k in enumerate(kept))
                texts.append(text)
            yield span_rows(batch.column(0), texts, spans, schema)

    return both.mapInArrow(cut, schema)


def span_rows(ids: pa.Array, texts: list, spans: list[list[tuple[int, int]]], schema: T.StructType) -> pa.RecordBatch:
    """Rows of doc_id, text, n_removed, removed_chars, spans."""
    counts, sizes = [len(x) for x in spans], [sum(b - a for a, b in x) for x in spans]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    held = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), held], names=schema.names)
