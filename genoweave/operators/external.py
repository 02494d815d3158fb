"""Gene finders other than the engine's own: a function over one contig, run where the contigs are."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..plans.schemas import parsed
from .kernels import map_rows

CALLS = parsed("genome string, contig_idx int, k int, begin bigint, forward boolean, size bigint, protein string")
#: Contigs from this length on are long enough for a finder to be trained on.
LONG = 20_000


def called(contigs: DataFrame, finder: Callable[[str], Iterable[tuple[int, bool, str]]], min_orf: int = 0) -> DataFrame:
    """genome, contig_idx, k, frame, start, aa_len, protein of what finder(sequence) yields: (one-based begin, forward, protein).

    Proteins are sanitised first; those shorter than min_orf leave.
    """

    def run(genome, contig_idx, seq):
        for k, (begin, forward, protein) in enumerate(finder(seq)):
            yield genome, contig_idx, k, int(begin), bool(forward), len(seq), protein

    rows = map_rows(contigs.select("genome", "contig_idx", "seq"), run, CALLS)
    start = F.col("begin") - 1
    frame = F.when(F.col("forward"), start % 3).otherwise(3 + (F.col("size") - F.col("begin")) % 3).cast("int")
    rows = rows.withColumn("protein", sequence.sanitised(F.col("protein"))).withColumn("aa_len", F.length("protein"))
    return rows.where(F.col("aa_len") >= min_orf).select("genome", "contig_idx", "k", frame.alias("frame"), start.alias("start"), "aa_len", "protein")


def prodigal(meta: bool = True) -> Callable[[str], Iterable[tuple[int, bool, str]]]:
    """The finder of the optional package pyrodigal, with its metagenomic models or trained on each long contig."""
    if importlib.util.find_spec("pyrodigal") is None:
        raise RuntimeError("the gene finder pyrodigal isn't installed")

    def find(seq: str):
        import pyrodigal

        own = pyrodigal.GeneFinder(meta=meta or len(seq) < LONG)
        if not meta and len(seq) >= LONG:
            own.train(seq.encode())
        for gene in own.find_genes(seq.encode()):
            yield gene.begin, gene.strand == 1, gene.translate()

    return find
