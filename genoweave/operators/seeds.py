"""Spaced seeds: extraction, sampling, composition model, repeat mask, ORF sub-sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.schemas import parsed

from ..functions import hashing
from ..functions.constants import AMINO, RESIDUES
from ..functions.sequence import _RESIDUE
from ..plans.presets import Shape, parse_shape

ALPHABET = len(AMINO)
RAW = parsed("genome string, seg_idx bigint, aa_pos int, kmer bigint, hash32 bigint")
COUNTS = parsed("genome string, " + ", ".join(f"n{i} bigint" for i in range(ALPHABET)) + ", npos bigint")
#: ORFs whose residues are counted at once.
COUNTED = 2000
#: Residues whose seeds are made at once.
SLICE = 1 << 20


def raw_seeds(orfs: DataFrame, shape: Shape | str, scaled: int = 1, factor: int = 1) -> DataFrame:
    """Every sampled seed of (genome, seg_idx, protein): aa_pos, kmer (base-20 value), hash32.

    The sampling thresholds are tested in the kernel, before a seed becomes a row.
    """
    shape = parse_shape(shape) if isinstance(shape, str) else shape
    most = np.uint64(hashing.sample_threshold(scaled))
    below = np.uint64((1 << 32) // factor)
    low = np.uint64(0xFFFFFFFF)

    def extract(batches):
        for batch in batches:
            text = batch.column(2).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(text):
                end = min(len(text), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
                codes = _RESIDUE[data[offsets[at] : offsets[end]]].astype(np.uint64)
                starts = offsets[at : end + 1] - offsets[at]
                row = np.repeat(np.arange(end - at), np.diff(starts))
                known = codes < ALPHABET
                for pattern in shape.patterns:
                    n = len(codes) - pattern[-1]
                    if n <= 0:
                        continue
                    value, valid = np.zeros(n, np.uint64), row[:n] == row[pattern[-1] :]
                    for o in pattern:
                        value = value * np.uint64(ALPHABET) + codes[o : o + n]
                        valid &= known[o : o + n]
                    hashed = hashing.fmix64(value)
                    hit = np.flatnonzero(valid & (hashed <= most) & ((hashed & low) < below))
                    if len(hit):
                        of = pa.array(at + row[hit])
                        place = (hit - starts[row[hit]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(place), pa.array(value[hit].astype(np.int64)), pa.array((hashed[hit] & low).astype(np.int64))], names=RAW.names)
                at = end

    return orfs.select("genome", F.col("seg_idx").cast("bigint"), "protein").mapInArrow(extract, RAW)


def composition(orfs: DataFrame, shape: Shape) -> DataFrame:
    """genome, logp (array of 20 log shares, add-one smoothed), log_npos (log of the number of seed places)."""
    target = to_arrow_schema(COUNTS)

    def count(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for at in range(0, len(text), COUNTED):
                part = offsets[at : at + COUNTED + 1]
                rows, codes = np.repeat(np.arange(len(part) - 1), np.diff(part)), _RESIDUE[data[part[0] : part[-1]]]
                known = codes < ALPHABET
                sums = np.bincount(rows[known] * ALPHABET + codes[known], minlength=(len(part) - 1) * ALPHABET).reshape(-1, ALPHABET)
                # letters are counted by code point, as the places of seeds are
                length = np.bincount(rows, (data[part[0] : part[-1]] & 0xC0) != 0x80, len(part) - 1).astype(np.int64)
                places = sum((np.maximum(length - p[-1], 0) for p in shape.patterns), np.zeros(len(part) - 1, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, COUNTED), *[pa.array(sums[:, i], pa.int64()) for i in range(ALPHABET)], pa.array(places)], schema=target)

    counted = orfs.select("genome", "protein").mapInArrow(count, COUNTS)
    total = sum((F.col(f"n{i}") for i in range(ALPHABET)), F.lit(0))
    sums = counted.groupBy("genome").agg(*[F.sum(c).alias(c) for c in COUNTS.names[1:]])
    logp = F.array(*[F.log((F.col(f"n{i}") + 1.0) / (F.col("total") + ALPHABET)) for i in range(ALPHABET)])
    return sums.withColumn("total", total).select("genome", logp.alias("logp"), F.log(F.greatest(F.col("npos"), F.lit(1)).cast("double")).alias("log_npos"), "npos")


def with_nlogp(raw: DataFrame, comp: DataFrame, shape: Shape) -> DataFrame:
    """Seeds with nlogp = -256 ln E rounded, clipped to 0..65535; E is how often chance would make the seed in its genome."""
    digit = [F.expr(f"pmod(kmer div {ALPHABET ** (shape.weight - 1 - i)}, {ALPHABET})") for i in range(shape.weight)]
    log_p = F.element_at("logp", digit[0].cast("int") + 1)
    for d in digit[1:]:
        log_p = log_p + F.element_at("logp", d.cast("int") + 1)
    log_e = F.col("log_npos") + log_p
    value = -log_e * 256.0
    quantised = F.when(value <= 0, 0).when(value >= 65535.0, 65535).otherwise(F.floor(value + 0.5)).cast("int")
    return raw.join(comp.select("genome", "logp", "log_npos"), "genome").withColumn("nlogp", quantised).drop("logp", "log_npos")


def occurrence_cut(nlogp: Column, max_occ: int = 0) -> Column:
    if max_occ > 0:
        return F.lit(max_occ)
    e = F.exp(-nlogp / 256.0)
    return F.greatest(F.lit(2), F.floor(e + 4.0 * F.sqrt(e) + 0.5))


def masked(seeds: DataFrame, max_occ: int = 0) -> DataFrame:
    """Seeds whose hash its genome doesn't repeat too often, with n_occ and occ (number of the occurrence, from 0)."""
    run = Window.partitionBy("genome", "hash32")
    placed = run.orderBy("seg_idx", "aa_pos")
    out = seeds.withColumn("n_occ", F.count("*").over(run)).withColumn("first_nlogp", F.first("nlogp").over(placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("occ", F.row_number().over(placed) - 1)
    return out.where(F.col("n_occ") <= occurrence_cut(F.col("first_nlogp"), max_occ)).drop("first_nlogp")


def _dealt(raw: DataFrame) -> DataFrame:
    """Seeds dealt by genome. Hashes are made anew behind the shuffle, a few bytes less a row."""
    raw = raw.select("genome", "seg_idx", "aa_pos", "kmer").repartition("genome")
    return hashing.with_fmix64(raw, "kmer", "hash").withColumn("hash32", F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))).drop("hash")


def extract_seeds(orfs: DataFrame, shape: Shape | str, scaled: int, max_occ: int = 0, factor: int = 1, dealt: bool = False) -> DataFrame:
    """genome, hash32, seg_idx, aa_pos, nlogp, n_occ, occ after sampling and masking. dealt: every genome's seeds in one partition."""
    shape = parse_shape(shape) if isinstance(shape, str) else shape
    raw = raw_seeds(orfs, shape, scaled, factor)
    raw = _dealt(raw) if dealt else raw
    return masked(with_nlogp(raw, composition(orfs, shape), shape), max_occ).select("genome", "hash32", "seg_idx", "aa_pos", "nlogp", "n_occ", "occ")


def marker_counts(orfs: DataFrame, shape: Shape | str, scaled: int, max_occ: int = 0, factor: int = 1) -> DataFrame:
    """genome, hash32, n_occ of extract_seeds, each hash once; every genome's in one partition. Chances are looked up where occurrences may be too many."""
    shape = parse_shape(shape) if isinstance(shape, str) else shape
    place = F.shiftleft("seg_idx", 32).bitwiseOR(F.col("aa_pos").cast("bigint"))
    found = _dealt(raw_seeds(orfs, shape, scaled, factor)).groupBy("genome", "hash32").agg(F.count("*").alias("n_occ"), F.min_by("kmer", place).alias("kmer"))
    if max_occ > 0:
        return found.where(F.col("n_occ") <= max_occ).select("genome", "hash32", "n_occ")
    # no cut is under 2
    kept = with_nlogp(found, composition(orfs, shape), shape).where((F.col("n_occ") <= 2) | (F.col("n_occ") <= occurrence_cut(F.col("nlogp"))))
    return kept.select("genome", "hash32", "n_occ")


def marker_hashes(orfs: DataFrame, shape: Shape | str, scaled: int, max_occ: int = 0, factor: int = 1) -> DataFrame:
    """genome, hash32 of extract_seeds, each once."""
    return marker_counts(orfs, shape, scaled, max_occ, factor).select("genome", "hash32").sortWithinPartitions("genome")


def packed(protein: str) -> bytes:
    """Residues at five bits, least significant first."""
    codes = _RESIDUE[np.frombuffer(protein.encode(), np.uint8)]
    bits = (codes[:, None] >> np.arange(5)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, length: int) -> str:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: 5 * length].reshape(-1, 5)
    codes = (bits * (1 << np.arange(5))).sum(axis=1)
    return np.frombuffer(RESIDUES.encode(), np.uint8)[np.minimum(codes, 20)].tobytes().decode()


def orf_hash(genome: str, protein: str, role: int = 0) -> int:
    """The hash by which ORFs are sub-sampled: salted by genome name and role, folded over the packed residues."""
    h = hashing.fmix64_int(hashing.fnv1a(genome.encode()) ^ role) ^ len(protein)
    data = packed(protein)
    for k in range(0, len(data), 8):
        h = hashing.fmix64_int(h ^ int.from_bytes(data[k : k + 8], "little"))
    return h


def subsampled_orfs(orfs: DataFrame, gene_scaled: int, role: int = 0) -> DataFrame:
    """One in gene_scaled ORFs; the two sides of a comparison sample independently."""
    if gene_scaled <= 1:
        return orfs
    below = hashing.sample_threshold(gene_scaled)
    names = orfs.columns
    g, p = names.index("genome"), names.index("protein")

    def keep(batches):
        for batch in batches:
            hit = [orf_hash(a.as_py(), b.as_py(), role) < below for a, b in zip(batch.column(g), batch.column(p), strict=True)]
            yield batch.filter(pa.array(hit, pa.bool_()))

    return orfs.mapInArrow(keep, orfs.schema)
