"""Near-duplicate classes by a multi-index Hamming join of b-bit MinHash signatures.

A signature is 24 MinHash symbols of 14 bits in six chunks of four. Two signatures that differ in at most ``MAX_ERRORS`` = 11 symbols
have, by pigeonhole, a chunk with at most one error, so they agree in one of its four forms with one symbol left out: 24 keys a
document find every pair under the threshold. A pair of similarity 0.85 differs in over 11 symbols less often than once in 10,000.

Texts with equal shingle sets are one class first. A bucket of the index never emits all its pairs: its classes are
compared with one hub, the most central of them, and only classes that are still in different components, and share one of their
rarest shingles (prefix filter), are compared with one another. In a large bucket of such shingles that goes by rounds: a class is compared
with one random member at first, then with ``GROWTH`` times as many a round, and leaves once it has joined them, so the links that a round finds grow with
its classes, not with their pairs. The last round compares all that are still apart. Every candidate pair is confirmed on the full sets of 64-bit shingle hashes. Buckets are aggregated and joined, so a hot bucket is combined map-side and can be split.

Defined results: null and empty texts, or texts without words, have no shingles and are linked with nothing; a text of fewer
than three words is one shingle; component_id is the smallest non-null doc_id reachable; rows that repeat a doc_id share its flag in
``near_duplicates``; ``drop_near_copies`` keeps one row of each component, that of the smallest doc_id (nulls last), whatever ids repeat or are null, and every text without words; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import WORD, materialize, tidy
from .components import connected_components

CHUNKS, IN_CHUNK, BITS, MAX_ERRORS = 6, 4, 14, 11
SYMBOLS = CHUNKS * IN_CHUNK
LANE = BITS + 1
#: Buckets of over WIDE classes are compared by rounds; each round has GROWTH times as many members of a bucket to compare with.
WIDE, GROWTH = 16, 8
#: Shingles by which a class may differ from its hub for pairs of the hub's classes to be decided by these differences.
MAX_DELTA = 64
#: Lists of documents to fetch are broadcast up to this many; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
SIMILARITY = 85
WIDTH = 3

_rng = np.random.default_rng(77)
_ODD = _rng.integers(1, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(1, 2**64, SYMBOLS, dtype=np.uint64)
_CHUNK_COLUMNS = [f"c{i}" for i in range(CHUNKS)]
_LOW = sum(((1 << BITS) - 1) << (LANE * i) for i in range(IN_CHUNK))
_HIGH = sum(1 << (LANE * i + BITS) for i in range(IN_CHUNK))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), d0 and d1 (128-bit digest of the set), c0 to c5 (chunks of the signature), uid (hash of doc_id and text)."""
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    longs = ["n", "d0", "d1", *_CHUNK_COLUMNS]
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in [*longs, "uid"])])

    def sign(batches):
        for batch in batches:
            out = np.zeros((len(longs), batch.num_rows), np.uint64)
            for row, data, starts in shingles.slices(batch.column(1)):
                found, owner = shingles.sets(data, starts, width)
                docs_, begin = shingles.starts_of(owner)
                if not len(docs_):
                    continue
                at = row + docs_
                out[0, at] = np.diff(np.append(begin, len(owner))).astype(np.uint64)
                out[1, at] = np.add.reduceat(shingles.mix64(found ^ np.uint64(0xA5A5A5A55A5A5A5A)), begin)
                out[2, at] = np.add.reduceat(shingles.mix64(found + np.uint64(0x1234567887654321)), begin)
                for k in range(SYMBOLS):
                    least = np.minimum.reduceat((found ^ _XOR[k]) * _ODD[k], begin)
                    symbol = shingles.mix64(least) & np.uint64((1 << BITS) - 1)
                    out[3 + k // IN_CHUNK, at] |= symbol << np.uint64(LANE * (k % IN_CHUNK))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.view(np.int64)) for c in out), batch.column(2)], names=["doc_id", *longs, "uid"])

    return source.mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """d0, d1 and the sorted shingle hashes of each text that has words."""
    schema = T.StructType([T.StructField("d0", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def build(batches):
        for batch in batches:
            for _, data, starts in shingles.slices(batch.column(0)):
                found, owner = shingles.sets(data, starts, width)
                docs_, begin = shingles.starts_of(owner)
                if not len(docs_):
                    continue
                d0 = np.add.reduceat(shingles.mix64(found ^ np.uint64(0xA5A5A5A55A5A5A5A)), begin)
                d1 = np.add.reduceat(shingles.mix64(found + np.uint64(0x1234567887654321)), begin)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(found)).astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d0.view(np.int64)), pa.array(d1.view(np.int64)), lists], names=["d0", "d1", "shingles"])

    return docs.select("text").mapInArrow(build, schema)


def index_keys() -> Column:
    """The 24 keys of a signature: each chunk with each one of its symbols left out."""
    keys = []
    for c, name in enumerate(_CHUNK_COLUMNS):
        for i in range(IN_CHUNK):
            mask = _LOW & ~(((1 << BITS) - 1) << (LANE * i))
            keys.append(F.xxhash64(F.lit(c * IN_CHUNK + i), F.col(name).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def errors(left: str, right: str) -> Column:
    """Number of symbols in which two signatures differ."""
    total = F.lit(0)
    for c in _CHUNK_COLUMNS:
        differs = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        total = total + F.bit_count((differs + F.lit(_LOW)).bitwiseAND(F.lit(_HIGH)))
    return total


def possible(left: str, right: str, similarity: int) -> Column:
    """Under the signature-distance threshold, and of sizes that allow the similarity."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * similarity) & (errors(left, right) <= MAX_ERRORS)


class Finder:
    """Candidate pairs and their confirmation over one table of documents."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY):
        self.docs, self.width, self.similarity = docs.select("doc_id", "text"), width, similarity
        self.rows = materialize(signatures(self.docs, width), "near-rows")
        classes = self.rows.where("n > 0").groupBy("d0", "d1", "n", *_CHUNK_COLUMNS).agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first"))
        self.classes = materialize(classes.withColumn("nid", F.monotonically_increasing_id()), "near-classes")
        keys = self.classes.select("nid", F.explode(index_keys()).alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        #: Members of the buckets that hold more than one class.
        self.members = materialize(keys.join(shared, "key"), "near-members")
        self.labels: DataFrame | None = None
        self.tested: DataFrame | None = None

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those not tested before that the signatures allow."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        own = self.classes.select("nid", "n", *_CHUNK_COLUMNS)
        both = pairs.join(own.alias("l"), F.col("a") == F.col("l.nid")).join(own.alias("r"), F.col("b") == F.col("r.nid"))
        return both.where(possible("l", "r", self.similarity)).select("a", "b", F.col("l.n").alias("na"), F.col("r.n").alias("nb"))

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """nodes(nid) -> (nid, shingles): the full sets, built from the whole text of one document of each class."""
        wanted = materialize(self.classes.join(nodes, "nid", "left_semi").select("nid", "d0", "d1", F.col("first_id").alias("doc_id")), "near-wanted")
        ids = wanted.select("doc_id").distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
        whole = self.docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
        # rows of a repeated doc_id may have other texts; the digest tells which are meant
        sets = shingle_sets(whole, self.width).join(wanted.select("nid", "d0", "d1"), ["d0", "d1"]).dropDuplicates(["nid"])
        return materialize(sets.select("nid", "shingles"), "near-sets")

    def confirm(self, candidates: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Links among the candidate pairs, by the sizes of intersection and union of full sets."""
        pairs = materialize(candidates, "near-pairs")
        if sets is None:
            sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct())
        left = pairs.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        found = both.select("a", "b", common.alias("k"), "na", "nb").where(F.col("k") * 100 >= (F.col("na") + F.col("nb") - F.col("k")) * self.similarity)
        tested = pairs.select("a", "b")
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)
        return materialize(found.select("a", "b"), "near-links")

    def prefixes(self, sets: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rarest shingles of each set, of which two sets of the wanted similarity share one, with their places.

        Any one order of all shingles will do; shingles that no other of these sets has can't be shared.
        """
        tokens = sets.select("nid", F.explode("shingles").alias("s"))
        known = tokens.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
        place = F.row_number().over(Window.partitionBy("nid").orderBy(F.coalesce("f", F.lit(1)), "s"))
        ranked = tokens.join(known, "s", "left").withColumn("p", place).where("f > 1")
        return ranked.join(nodes, "nid").where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * self.similarity / 100) + 1)

    def with_deltas(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """nodes with hub_n, gone and extra: size of the hub's set and the differences from it; no hub where they are many."""
        hubs = sets.select(F.col("nid").alias("hub"), F.col("shingles").alias("hub_set"))
        both = nodes.join(sets.select("nid", "shingles"), "nid").join(hubs, "hub")
        both = both.withColumn("gone", F.array_except("hub_set", "shingles")).withColumn("extra", F.array_except("shingles", "hub_set"))
        near = F.size("gone") + F.size("extra") <= MAX_DELTA
        blank = F.array().cast("array<bigint>")
        return both.select(
            "nid", "label", "n", *_CHUNK_COLUMNS, F.when(near, F.col("hub")).alias("hub"), F.size("hub_set").cast("long").alias("hub_n"),
            *[F.when(near, F.col(c)).otherwise(blank).alias(c) for c in ("gone", "extra")],
        )

    def add(self, links: DataFrame) -> bool:
        """Merge the components that the links join; links between the same two components count once. Whether there were any."""
        if self.labels is None:
            self.labels = materialize(connected_components(links, "near-cc"), "near-labels")
            return True
        if links.isEmpty():
            return False
        ends = links
        for c in ("a", "b"):
            own = self.labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
            ends = ends.join(own, c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
        merged = materialize(connected_components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), "near-cc"), "near-merged")
        moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
        old = self.labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new = merged.join(self.labels.select("node"), "node", "left_anti")
        self.labels = materialize(old.unionByName(new), "near-labels")
        tidy(links.sparkSession)
        return True

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows(nid, ...) with the label of each."""
        named = rows.join(self.labels.withColumnRenamed("node", "nid"), "nid", "left")
        return named.withColumn("label", F.coalesce("label", "nid"))

    def open_members(self) -> DataFrame:
        """Members, with their labels, of the buckets that still hold several components."""
        named = self.labelled(self.members.select("key", "nid"))
        still = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        return materialize(named.join(still, "key", "left_semi"), "near-open")

    def still_open(self, rows: DataFrame) -> DataFrame:
        """rows(s, nid, ...), with their present labels, of the buckets that hold several components."""
        rows = materialize(self.labelled(rows.drop("label")), "near-rows")
        several = rows.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("s")
        return rows.join(several, "s", "left_semi")

    def apart(self, left: DataFrame, right: DataFrame, order: Column | None = None) -> DataFrame:
        """Pairs (a, b) of classes in different components that share a rare shingle and may be similar enough."""
        order = F.col("l.label") != F.col("r.label") if order is None else order
        room = F.least(F.col("l.n") - F.col("l.p"), F.col("r.n") - F.col("r.p")) + 1
        enough = room * (100 + self.similarity) >= (F.col("l.n") + F.col("r.n")) * self.similarity
        # of two classes near one hub, the differences from it give the intersection: such pairs are decided here
        common = F.col("l.hub_n") - F.size("l.gone") - F.size("r.gone") + F.size(F.array_intersect("l.gone", "r.gone")) + F.size(F.array_intersect("l.extra", "r.extra"))
        decided = (F.col("l.hub") == F.col("r.hub")) & (common * 100 < (F.col("l.n") + F.col("r.n") - common) * self.similarity)
        on = (F.col("l.s") == F.col("r.s")) & order & enough & possible("l", "r", self.similarity) & ~F.coalesce(decided, F.lit(False))
        return left.alias("l").join(right.alias("r"), on).select(F.col("l.nid").alias("a"), F.col("r.nid").alias("b"))

    def run(self) -> DataFrame:
        """(nid, label) of the classes that have links."""
        # first hub: the class that shares most keys with most others, so the text that copies stem from rather than a copy
        central = self.members.groupBy("nid").agg(F.sum("size").alias("score"))
        rows = self.members.join(central, "nid").select("key", "nid", "score")
        hubs = rows.groupBy("key").agg(F.max(F.struct("score", (-F.col("nid")).alias("m"))).alias("h"))
        rows = rows.join(hubs, "key").groupBy("nid", "h").agg(F.count("*").alias("n_keys"))
        hub_of = materialize(rows.groupBy("nid").agg(F.max("h").alias("h")).select("nid", (-F.col("h.m")).alias("hub")), "near-hubs")
        self.add(self.confirm(self.pairs(rows.select((-F.col("h.m")).alias("a"), F.col("nid").alias("b")).where("a <> b"))))
        # the rest: pairs under the signature threshold in different components; two sets of the wanted similarity
        # share one of their rarest shingles, at places that leave room for enough others
        own = self.classes.select("nid", "n", *_CHUNK_COLUMNS)
        nodes = materialize(self.open_members().select("nid", "label").distinct().join(own, "nid").join(hub_of, "nid"), "near-nodes")
        sets = self.sets_of(nodes.select(F.explode(F.array("nid", "hub")).alias("nid")).distinct())
        nodes = materialize(self.with_deltas(nodes, sets), "near-deltas")
        rows = materialize(self.prefixes(sets, nodes), "near-prefixes")
        buckets = rows.groupBy("s").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        wide = materialize(buckets.where(F.col("m") > WIDE).select("s", "m"), "near-wide")
        narrow = rows.join(buckets.where(F.col("m") <= WIDE).select("s"), "s", "left_semi")
        rows = materialize(rows.join(wide, "s"), "near-rows")
        largest, sampled, found = wide.agg(F.max("m")).first()[0] or 0, 1, True
        while found and sampled < largest:
            rows = self.still_open(rows.where(F.col("m") > sampled // GROWTH))
            hubs = rows.where(F.pmod(F.xxhash64("nid", "s"), F.col("m")) < sampled)
            found = self.add(self.confirm(self.pairs(self.apart(rows, hubs)), sets))
            sampled *= GROWTH
        rows, ordered = self.still_open(rows), F.col("l.label") < F.col("r.label")
        rest = self.apart(rows, rows, ordered).unionByName(self.apart(narrow, narrow, ordered))
        self.add(self.confirm(self.pairs(rest), sets))
        return self.labels


def classified(finder: Finder) -> DataFrame:
    """d0, d1, component_id, uid (of the row that stays of the component) of each class."""
    labels = finder.run()
    classes = finder.classes.select("nid", "d0", "d1", "first_id", "first").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    least = classes.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("first").alias("least"))
    return materialize(classes.join(least, "label").select("d0", "d1", "component_id", F.col("least.uid").alias("uid")), "near-result")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    finder = Finder(docs, width, similarity)
    classes = classified(finder).drop("uid")
    words = finder.rows.where("n > 0").join(classes, ["d0", "d1"])
    empty = finder.rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    out = words.select("doc_id", "n", "component_id").unionByName(empty.select("doc_id", "n", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """docs without the near copies: one row of each component stays; columns and whole texts unchanged."""
    kept = classified(Finder(docs, width, similarity)).select(F.col("uid").alias("__uid")).distinct()
    found = docs.withColumn("__own", F.xxhash64("doc_id", "text")).join(kept, F.col("__own") == F.col("__uid"))
    once = Window.partitionBy("__uid").orderBy(F.col("text").desc_nulls_last())
    named = found.withColumn("__k", F.row_number().over(once)).where("__k = 1").select(*docs.columns)
    return named.unionByName(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
