"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, hashed to ``WORDS`` buckets, trigrams of byte classes (letters, capitals, digits, blanks, marks, symbols ...) and
word forms (length, first letter, whether the word repeats the one before). Square-rooted shares of each kind, weighted by rarity, are projected on the leading singular vectors of
the labelled sample. The sample's unit vectors are broadcast; every document's exact cosines with all of them are computed in
blocks, and the labels of the nearest ones vote, weighted by similarity. The same counts of both labels are sampled, so a vote isn't
swayed by how common a label is.

The sample is bounded: at most ``PER_LABEL`` rows of each label, those with the lowest hash of their doc_id. Everything else covers all rows.

Defined results: a text without bytes (null or empty) has no vector and scores the sample's share of label 1 in the table of labels;
without any usable label every score is 0.5; a doc_id that has several labels counts with the lowest; null labels don't count;
repeated rows score alike; an empty table gives an empty result; further columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles

PER_LABEL, DIMENSIONS, TERMS, NEIGHBOURS, SHARPNESS = 1500, 32, 800, 25, 12
#: Buckets of words; documents whose terms are counted at once.
WORDS, BLOCK = 2048, 256
THRESHOLD = 0.3

_KIND = np.full(256, 11, np.uint8)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\v\f\r", b".", b",", b"!?", b";:'\"()-", b"#$%&*@|<>{}[]~^_=+/\\`")):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 10
_KINDS = 12
_FORMS = 6 * 2 * 4
#: Where each kind of terms begins: trigrams, word forms, words.
_BOUNDS = (0, _KINDS**3, _KINDS**3 + _FORMS, _KINDS**3 + _FORMS + WORDS)
ALL_TERMS = _BOUNDS[-1]


def term_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Documents x terms, float32, of documents that begin at starts in data."""
    m = len(starts)
    out = np.zeros((m, ALL_TERMS), np.float32)
    again_from = (np.uint64(0), -1)
    for a, b in shingles.pieces(data):
        first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        last = int(np.searchsorted(starts, b))
        again_from = _count(out[first:last], data[a:b], np.maximum(starts[first:last] - a, 0), data[max(0, a - 2) : a] if a > starts[first] else data[:0], again_from if a > starts[first] else None)
    return out


def _count(out: np.ndarray, data: np.ndarray, starts: np.ndarray, before: np.ndarray, word_before) -> tuple:
    """Adds the counts of a piece; before and word_before are what the first document has ahead of it. The last word's hash."""
    m = len(starts)
    whole = np.concatenate([before, data])
    doc = np.repeat(np.arange(m), np.diff(np.append(starts, len(data))))
    doc = np.concatenate([np.zeros(len(before), doc.dtype), doc])
    kind = _KIND[whole].astype(np.int64)
    if len(whole) > 2:
        code = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]
        same = doc[:-2] == doc[2:]
        out[:, : _BOUNDS[1]] += np.bincount(doc[:-2][same] * _KINDS**3 + code[same], minlength=m * _KINDS**3).reshape(m, -1)
    word, owner = shingles.words(data, starts)
    if not len(word):
        return word_before
    space = shingles._SPACE[data]
    begins = np.concatenate([[True], space[:-1]])
    begins[starts[(starts > 0) & (starts < len(data))]] = True
    at = np.flatnonzero(~space & begins)
    length = np.add.reduceat((~space).astype(np.int64), at)
    bucket = np.searchsorted([3, 5, 7, 10, 15], length, "right")
    again = np.zeros(len(word), np.int64)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    again[0] = word_before is not None and owner[0] == 0 and word_before[0] == word[0]
    initial = np.array([0, 1, 2, 3, 3, 3, 3, 3, 3, 3, 0, 3])[_KIND[data[at]]]
    out[:, _BOUNDS[1] : _BOUNDS[2]] += np.bincount(owner * _FORMS + (bucket * 2 + again) * 4 + initial, minlength=m * _FORMS).reshape(m, -1)
    out[:, _BOUNDS[2] :] += np.bincount(owner * WORDS + (word % np.uint64(WORDS)).astype(np.int64), minlength=m * WORDS).reshape(m, -1)
    return word[-1], owner[-1]


class Model:
    """What is broadcast: chosen terms, their weights and projection, the sample's vectors and labels, and the fallback score."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, fallback: float):
        self.fallback = fallback
        self.labels = labels.astype(np.float32)
        self.vectors = None
        if not len(counts):
            return
        shares = self.shares(counts)
        self.terms = np.sort(np.argsort(-shares.var(axis=0), kind="stable")[:TERMS])
        present = (shares[:, self.terms] > 0).sum(axis=0)
        self.weights = np.log((1 + len(counts)) / (1 + present)).astype(np.float32) + 1
        x = shares[:, self.terms] * self.weights
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        top = np.argsort(-values)[:DIMENSIONS]
        self.axes = vectors[:, top].astype(np.float32)
        self.vectors = self.unit(x @ self.axes)

    @staticmethod
    def shares(counts: np.ndarray) -> np.ndarray:
        """Square roots of shares, each kind of terms apart."""
        out = counts.astype(np.float32, copy=True)
        for a, b in zip(_BOUNDS, _BOUNDS[1:], strict=False):
            out[:, a:b] /= np.maximum(1, out[:, a:b].sum(axis=1, keepdims=True))
        return np.sqrt(out)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))

    def scores(self, counts: np.ndarray, empty: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.fallback)
        if self.vectors is None:
            return out
        near = min(NEIGHBOURS, len(self.vectors))
        x = self.unit((self.shares(counts)[:, self.terms] * self.weights) @ self.axes)
        for a in range(0, len(x), BLOCK):
            cosines = x[a : a + BLOCK] @ self.vectors.T
            top = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosines, top, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[a : a + BLOCK] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        out[empty] = self.fallback
        return np.round(np.clip(out, 0, 1), 6)


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text is divisible by 5; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 1) -> Model:
    """A model from labelled rows that aren't held out; at most per_label rows of each label reach the driver."""
    rows = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~is_held_out())
    sums = rows.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
    fallback = sums[1] / sums[0] if sums[0] else 0.5
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = [rows.where(F.col("quality") == 1).orderBy(*order).limit(per_label), rows.where(F.col("quality") != 1).orderBy(*order).limit(per_label)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    found = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", (F.col("quality") == 1).cast("int").alias("y"), "text")
    # rows that repeat a doc_id must not widen the sample: the least terms of them count
    schema = T.StructType([found.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("terms", T.BinaryType())])

    def count(batches):
        for batch in batches:
            for row, data, starts in shingles.slices(batch.column(2)):
                found_terms = []
                for counts in term_counts(data, starts):
                    some = np.flatnonzero(counts)
                    found_terms.append(some.astype("<u2").tobytes() + counts[some].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(starts)), batch.column(1).slice(row, len(starts)), pa.array(found_terms, pa.binary())], names=["doc_id", "y", "terms"])

    got = found.mapInArrow(count, schema).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("terms").alias("terms")).toArrow().sort_by("doc_id")
    counts = np.zeros((len(got), ALL_TERMS), np.float32)
    for row, value in zip(counts, got["terms"], strict=True):
        data = value.as_py()
        n = len(data) // 6
        row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return Model(counts, got["y"].to_numpy(), fallback)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs, whole rows, with a score from the text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))  # plain arrays: the class travels with the function
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def rate(batches):
        held = Model.__new__(Model)
        vars(held).update(shared.value)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for row, data, starts in shingles.slices(batch.column(at)):
                sizes = np.diff(np.append(starts, len(data)))
                for a in range(0, len(starts), BLOCK):
                    b = min(len(starts), a + BLOCK)
                    begin, end = starts[a], starts[b] if b < len(starts) else len(data)
                    out[row + a : row + b] = held.scores(term_counts(data[begin:end], starts[a:b] - begin), sizes[a:b] == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(rate, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rated = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return rated.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under threshold; columns and whole texts unchanged."""
    name = "__quality_score"
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
