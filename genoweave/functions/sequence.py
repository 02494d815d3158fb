"""Nucleotide and protein strings: encoding, codons, translation, measures of a reading frame."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AMINO, CODE, CODON_SHARE, RESIDUES, SITE_SCAN, START_SCAN

_BASE = np.full(256, 4, np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    _BASE[list(_letters)] = _i
_RESIDUE = np.full(256, 21, np.uint8)
_RESIDUE[list(RESIDUES.encode())] = np.arange(21)
_AMINO_OF_CODON = np.frombuffer(CODE.encode(), np.uint8)
STOPS = np.array([c == "*" for c in CODE])
#: Stops of the other strand, read on this one.
REVERSE_STOPS = np.zeros(64, bool)
for _c in np.flatnonzero(STOPS):
    REVERSE_STOPS[(3 - _c % 4) * 16 + (3 - _c // 4 % 4) * 4 + (3 - _c // 16)] = True
START_CODONS = ("ATG", "GTG", "TTG")
SITE = (0, 2, 2, 0, 2, 2)  # AGGAGG
_LOG_SHARE = np.array([[math.log(x) for x in row] for row in CODON_SHARE.tolist()])


def encode(seq: str) -> np.ndarray:
    """A C G T or U as 0 to 3, anything else 4."""
    return _BASE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def residues(protein: str) -> np.ndarray:
    return _RESIDUE[np.frombuffer(protein.encode("ascii", "replace"), np.uint8)]


def codons(codes: np.ndarray) -> np.ndarray:
    """Numbers of the complete codons from the first base on; -1 for one with an unknown base."""
    whole = codes[: len(codes) // 3 * 3].reshape(-1, 3).astype(np.int32)
    out = whole[:, 0] * 16 + whole[:, 1] * 4 + whole[:, 2]
    out[(whole > 3).any(axis=1)] = -1
    return out


def reverse_complement(codes: np.ndarray) -> np.ndarray:
    out = 3 - codes[::-1].astype(np.int16)
    out[out < 0] = 4
    return out.astype(np.uint8)


def snr(codes: np.ndarray) -> float:
    """Period-3 signal: spread of each base over the three phases against that of chance."""
    counts = phase_counts(codes)
    n = counts.sum()
    if n < 9:
        return 0.0
    base = counts.sum(axis=1)
    spread = 1.5 * in_turn((counts - base[:, None] / 3) ** 2)
    share = base / n
    chance = n * in_turn(share * (1 - share))
    return spread / chance if chance > 1 else 0.0


def in_turn(values: np.ndarray) -> float:
    """Sum from the first value to the last: numpy's own order differs by length, and measures are compared with thresholds they may equal."""
    total = 0.0
    for x in values.ravel().tolist():
        total += x
    return total


def phase_counts(codes: np.ndarray) -> np.ndarray:
    """4 x 3 counts of bases by phase."""
    phase = np.arange(len(codes)) % 3
    known = codes < 4
    return np.bincount(codes[known].astype(np.int64) * 3 + phase[known], minlength=12).reshape(4, 3).astype(float)


def composition_score(codes: np.ndarray) -> float:
    """How much better the codon-position shares explain the coding strand than its own composition does, per base."""
    counts = phase_counts(codes[: len(codes) // 3 * 3])
    total = counts.sum()
    if not total:
        return 0.0
    base = counts.sum(axis=1)
    own = np.array([b * math.log((b + 0.5) / (total + 2)) for b in base.tolist()])
    return float((in_turn(counts * _LOG_SHARE) - in_turn(own)) / total)


def measures(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """snr and composition_score of many frames from their counts (frames x 4 x 3), summed in the same order."""
    base = counts.sum(axis=2)
    n = base.sum(axis=1)
    spread, chance, known, own = np.zeros((4, len(counts)))
    whole = np.maximum(n, 1)
    logs = np.array([math.log(x) for x in ((base + 0.5) / (n + 2)[:, None]).ravel().tolist()]).reshape(-1, 4)
    for b in range(4):
        share = base[:, b] / whole
        chance += share * (1 - share)
        own += base[:, b] * logs[:, b]
        for p in range(3):
            spread += (counts[:, b, p] - base[:, b] / 3) ** 2
            known += counts[:, b, p] * _LOG_SHARE[b, p]
    chance = n * chance
    enough = (n >= 9) & (chance > 1)
    return np.where(enough, 1.5 * spread / np.where(enough, chance, 1), 0.0), (known - own) / whole


def site_score(codes: np.ndarray, five_prime: int) -> int:
    """Best ribosome-site match upstream of a start among the first codons; codes are those of the coding strand's contig."""
    n, best = len(codes), 0

    def base(at: int) -> int:
        return int(codes[at]) if 0 <= at < n else 4

    for c in range(SITE_SCAN):
        at = five_prime + 3 * c
        if not (base(at) in (0, 2, 3) and base(at + 1) == 3 and base(at + 2) == 2):
            continue
        for d in range(6, 15):
            run = longest = 0
            for k in range(6):
                run = run + 1 if base(at - d + k) == SITE[k] else 0
                longest = max(longest, run)
            best = max(best, longest + (4 <= d - 5 <= 10))
    return best


def start_offset(codon_numbers: np.ndarray, min_orf: int) -> int:
    """Codons to cut so that the frame begins with a start codon, 0 if none is near enough."""
    limit = min(START_SCAN, len(codon_numbers) - min_orf)
    for c in range(max(0, limit)):
        if codon_numbers[c] in (14, 46, 62):
            return c
    return 0


def translate(codon_numbers: np.ndarray) -> str:
    return _AMINO_OF_CODON[codon_numbers].tobytes().decode()


# ---- native columns ----

_BASES = "ACGT"


def encoded(seq: Column) -> Column:
    """A C G T of the upper-cased sequence, U read as T, anything else N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def reverse_complemented(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def codon_array(nt: Column) -> Column:
    """Complete codons of a coding strand."""
    return F.regexp_extract_all(nt, F.lit("..."), F.lit(0))


def translated(nt: Column) -> Column:
    """Standard code over complete codons; unknown bases give X."""
    order = F.lit(_BASES)
    number = lambda c, i: F.instr(order, F.substring(c, i, 1)) - 1
    letter = lambda c: F.when(F.instr(c, "N") > 0, "X").otherwise(F.substring(F.lit(CODE), number(c, 1) * 16 + number(c, 2) * 4 + number(c, 3) + 1, 1))
    return F.array_join(F.transform(codon_array(nt), letter), "")


def sanitised(protein: Column) -> Column:
    """One trailing stop off; ambiguous residues to their nearest standard one, others to A."""
    bare = F.regexp_replace(F.upper(protein), r"\*$", "")
    return F.regexp_replace(F.translate(bare, "UOBZJ", "CKNQL"), f"[^{AMINO}]", "A")
