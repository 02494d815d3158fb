"""Reading frames: six-frame stop split, run lengths, order, measures, start trim and translation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..plans.schemas import parsed

from ..functions import sequence as S
from ..functions.constants import MAX_AA, MAX_RUN, SITE_MIN, SITE_SCAN, SNR_WINDOW
from ..plans.presets import GeneParams
from .kernels import map_rows

CANDIDATES = parsed(
    "genome string, contig_idx int, contig_len bigint, frame int, start bigint, aa_len int, close_at bigint, snr double, psi double, site int, nt string"
)
RUNS = parsed("genome string, aa_len int, n bigint")
WINDOWS = parsed("genome string, contig_idx int, window bigint, snr double, coding boolean")
HEXAMERS = parsed("genome string, hexamer int, n bigint, n_outside bigint")


def _runs(codes: np.ndarray, offset: int, stops: np.ndarray):
    """Runs between breaks of one reading frame: first codon, length, closed by stops at both ends."""
    numbers = S.codons(codes[offset:])
    n = len(numbers)
    is_stop = (numbers >= 0) & stops[np.maximum(numbers, 0)]
    breaks = np.flatnonzero(is_stop | (numbers < 0))
    first = np.concatenate([[0], breaks + 1])
    end = np.concatenate([breaks, [n]])
    by_stop = is_stop[breaks] if n else np.zeros(0, bool)
    closed = np.concatenate([[False], by_stop]) & np.concatenate([by_stop, [False]])
    return first, end - first, closed, n


def _scan(codes: np.ndarray, min_orf: int) -> list[np.ndarray]:
    """frame, start, aa_len, close_at of a contig's frames: arrays. Runs longer than MAX_AA come in pieces of that size from the left."""
    parts = [np.zeros((4, 0), np.int64)]
    for offset in range(3):
        if len(codes) < offset + 3:
            continue
        for reverse, stops in ((False, S.STOPS), (True, S.REVERSE_STOPS)):
            first, length, _, n = _runs(codes, offset, stops)
            first, length = first[length >= min_orf], length[length >= min_orf]
            pieces = -(-length // MAX_AA)
            skipped = MAX_AA * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            first = np.repeat(first, pieces) + skipped
            length = np.minimum(np.repeat(length, pieces) - skipped, MAX_AA)
            first, length = first[length >= min_orf], length[length >= min_orf]
            frame = np.full(len(first), 3 + (len(codes) - offset) % 3 if reverse else offset)
            parts.append(np.stack([frame, offset + 3 * first, length, n - first if reverse else first + length]))
    return list(np.concatenate(parts, axis=1))


def orf_spans(contigs: DataFrame, params: GeneParams = GeneParams()) -> DataFrame:
    """Maximal stop-free runs of known bases in all six frames: where they are, without measures or letters."""
    names = ["genome", "contig_idx", "contig_len", "frame", "start", "aa_len", "close_at"]
    schema = T.StructType([CANDIDATES[n] for n in names])

    def scan(batches):
        for batch in batches:
            found, sizes = [], []
            for seq in batch.column(2):
                codes = S.encode(seq.as_py())
                found.append(_scan(codes, params.min_orf))
                sizes.append(len(codes))
            row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            frame, start, length, close = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(4))
            at = pa.array(row)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.array(sizes, np.int64)[row]), pa.array(frame.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(close)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return contigs.select("genome", "contig_idx", "seq").mapInArrow(scan, schema)


def _phase_counts(codes: np.ndarray, reverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """frames x 4 x 3 counts of the bases of frames by phase, read on their own strand."""
    out, every = np.zeros((len(start), 4, 3)), np.arange(len(start))
    for b in range(4):
        # a row of before: how often the base stands in each phase of the contig ahead of a codon
        own = np.concatenate([codes == b, np.zeros(-len(codes) % 3, bool)]).reshape(-1, 3)
        before = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(own, axis=0)])
        for r in range(3):
            found = before[(end - r + 2) // 3, r] - before[(start - r + 2) // 3, r]
            out[every, np.where(reverse, 3 - b, b), np.where(reverse, end - 1 - r, r - start) % 3] = found
    return out


def _sites(strand: np.ndarray, five: np.ndarray) -> np.ndarray:
    """S.site_score of many places of a strand."""
    around = np.concatenate([np.full(14, 4, np.uint8), strand, np.full(3 * SITE_SCAN, 4, np.uint8)])
    window = around[five[:, None] + np.arange(14 + 3 * SITE_SCAN)]
    first, second, third = (window[:, 14 + k :: 3][:, :SITE_SCAN] for k in range(3))
    of, codon = np.nonzero(((first == 0) | (first == 2) | (first == 3)) & (second == 3) & (third == 2))
    upstream = window[of[:, None], 3 * codon[:, None] + np.arange(14)]
    apart = np.arange(6, 15)
    match = upstream[:, 14 - apart[:, None] + np.arange(6)] == np.array(S.SITE)
    run = longest = np.zeros(match.shape[:2], np.int64)
    for k in range(6):
        run = (run + 1) * match[:, :, k]
        longest = np.maximum(longest, run)
    best = (longest + ((apart >= 9) & (apart <= 15))).max(axis=1)
    out = np.zeros(len(five), np.int64)
    np.maximum.at(out, of, best)
    return out


def orf_candidates(contigs: DataFrame, params: GeneParams = GeneParams()) -> DataFrame:
    """The same runs with their measures and coding strand. A contig's frames are measured together."""
    min_orf = params.min_orf
    letters = np.frombuffer(b"ACGTN", np.uint8)

    def scan(genome, contig_idx, seq):
        codes = S.encode(seq)
        size = len(codes)
        frame, start, k, close = _scan(codes, min_orf)
        if not len(frame):
            return
        reverse, end = frame >= 3, start + 3 * k
        five = np.where(reverse, size - end, start)
        counts = _phase_counts(codes, reverse, start, end)
        snr, psi = S.measures(counts)
        site, texts = np.zeros(len(frame), np.int64), ["", ""]
        for turned in np.unique(reverse).tolist():
            strand, own = S.reverse_complement(codes) if turned else codes, reverse == turned
            site[own] = _sites(strand, five[own])
            texts[turned] = letters[strand].tobytes().decode()
        for row in zip(*(x.tolist() for x in (frame, start, k, close, snr, psi, site, reverse, five)), strict=True):
            yield (genome, contig_idx, size, *row[:7], texts[row[7]][row[8] : row[8] + 3 * row[2]])

    return map_rows(contigs.select("genome", "contig_idx", "seq"), scan, CANDIDATES, 2000)


def run_lengths(contigs: DataFrame) -> DataFrame:
    """Histogram of runs closed by stops at both ends, both strands, lengths clipped: genome, aa_len, n."""

    def count(genome, seq):
        codes, total = S.encode(seq), np.zeros(MAX_RUN + 1, np.int64)
        for offset in range(3):
            if len(codes) < offset + 3:
                continue
            for stops in (S.STOPS, S.REVERSE_STOPS):
                _, length, closed, _ = _runs(codes, offset, stops)
                whole = length[closed & (length < MAX_AA)]
                total += np.bincount(np.minimum(whole, MAX_RUN), minlength=MAX_RUN + 1)
        for k in np.flatnonzero(total):
            yield genome, int(k), int(total[k])

    parts = map_rows(contigs.select("genome", "seq"), count, RUNS)
    return parts.groupBy("genome", "aa_len").agg(F.sum("n").alias("n"))


def in_order(orfs: DataFrame) -> DataFrame:
    """seg_idx: contig, then frame, forward and reverse merged by closing codon, forward first."""
    place = Window.partitionBy("genome").orderBy("contig_idx", F.col("frame") % 3, "close_at", (F.col("frame") >= 3).cast("int"))
    return orfs.withColumn("seg_idx", (F.row_number().over(place) - 1).cast("bigint"))


def coding_windows(contigs: DataFrame, params: GeneParams = GeneParams()) -> DataFrame:
    """Whole windows of each contig and whether their period-3 signal is that of coding sequence."""
    size = max(params.window, 30)

    def windows(genome, contig_idx, seq):
        codes = S.encode(seq)
        for w in range(len(codes) // size):
            found = S.snr(codes[w * size : (w + 1) * size])
            yield genome, contig_idx, w, found, found > SNR_WINDOW

    return map_rows(contigs.select("genome", "contig_idx", "seq"), windows, WINDOWS)


def hexamers(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """hexamer, n, n_outside of a contig's known forward hexamers; windows of so many bases are coding or not."""
    n = len(codes) - 5
    if n <= 0:
        return None
    known = codes < 4
    value, valid = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(6):
        value = value * 4 + np.minimum(codes[k : k + n], 3)
        valid &= known[k : k + n]
    coding = np.array([S.snr(codes[w * size : (w + 1) * size]) > SNR_WINDOW for w in range(len(codes) // size)] + [False], bool)
    outside = valid & ~coding[np.minimum(np.arange(n) // size, len(coding) - 1)]
    every, free = np.bincount(value[valid], minlength=4096), np.bincount(value[outside], minlength=4096)
    found = np.flatnonzero(every)
    return found, every[found], free[found]


def background_hexamers(contigs: DataFrame, params: GeneParams = GeneParams()) -> DataFrame:
    """Forward hexamers of known bases: genome, hexamer, n (all), n_outside (starting outside coding windows)."""
    size = max(params.window, 30)

    def count(genome, seq):
        for h, n, free in zip(*(x.tolist() for x in hexamers(S.encode(seq), size) or ()), strict=True):
            yield genome, h, n, free

    parts = map_rows(contigs.select("genome", "seq"), count, HEXAMERS)
    return parts.groupBy("genome", "hexamer").agg(F.sum("n").alias("n"), F.sum("n_outside").alias("n_outside"))


def trimmed(orfs: DataFrame, params: GeneParams = GeneParams()) -> DataFrame:
    """Frames cut to their first start codon among the first codons; the reverse strand loses its right end. Native."""
    codon = S.codon_array(F.col("nt"))
    room = F.least(F.lit(30), F.col("aa_len") - params.min_orf)
    near = F.slice(codon, 1, F.greatest(room, F.lit(0)))
    first = F.array_position(F.transform(near, lambda c: c.isin(*S.START_CODONS)), True)
    cut = F.greatest(first.cast("int") - 1, F.lit(0))
    out = orfs.withColumn("cut", cut)
    return (
        out.withColumn("aa_len", F.col("aa_len") - F.col("cut"))
        .withColumn("start", F.when(F.col("frame") < 3, F.col("start") + 3 * F.col("cut")).otherwise(F.col("start")))
        .withColumn("nt", F.substring(F.col("nt"), 3 * F.col("cut") + 1, 3 * F.col("aa_len")))
        .drop("cut")
    )


def proteins(orfs: DataFrame) -> DataFrame:
    return orfs.withColumn("protein", S.translated(F.col("nt"))).drop("nt")


def has_site(site: Column) -> Column:
    return site >= SITE_MIN
