"""The function API: short calls over a session, with the library's own defaults for comparisons."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import external, orfs
from ..sources import fasta, genome_db, sinks
from . import api
from .presets import DEFAULT_PRESET, GeneParams, api_params
from .store import settled

#: Gene finders by name.
METHODS = ("native", "pyrodigal")


def _caller(method: str):
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    return external.prodigal() if method == "pyrodigal" else None


def find_genes(spark: SparkSession, seq: str, name: str = "genome", params: GeneParams = GeneParams()) -> DataFrame:
    """contig, frame, nuc_start, aa_len, protein of the genes on one sequence."""
    built = api.build(fasta.in_memory(spark, seq, name), params)
    return built.orfs.join(built.contigs.select("genome", "contig_idx", "contig"), ["genome", "contig_idx"]).orderBy("seg_idx").select("contig", "frame", "nuc_start", "aa_len", "protein")


def find_genes_stages(spark: SparkSession, seq: str, name: str = "genome", params: GeneParams = GeneParams()) -> dict[str, DataFrame]:
    """What each stage of gene calling makes of one sequence (api.gene_stages)."""
    return api.gene_stages(fasta.in_memory(spark, seq, name), params)


def build_db(spark: SparkSession, source: str | None = None, method: str = "native", name: str | None = None, seq: str | None = None, params: GeneParams = GeneParams()) -> api.GenomeTables:
    """Genome tables of one FASTA file (its records are contigs) or of one sequence."""
    if seq is None and source is None:
        raise ValueError("a FASTA file or a sequence is needed")
    contigs = fasta.in_memory(spark, seq, name or "genome") if seq is not None else fasta.fasta_folder(spark, source)
    if seq is None and name:
        from pyspark.sql import functions as F

        contigs = contigs.withColumn("genome", F.lit(name))
    return api.build(contigs, params, _caller(method))


def build_db_folder(spark: SparkSession, infolder: str, outfolder: str, method: str = "native", gff: bool = False, faa: bool = False, params: GeneParams = GeneParams()) -> api.GenomeTables:
    """Genome tables of all FASTA files of a folder, written and read back; gff and faa write the text forms beside them."""
    genome_db.require_folder(spark, infolder)
    return kept(api.build(fasta.fasta_folder(spark, infolder), params, _caller(method)), outfolder, gff, faa)


def kept(built: api.GenomeTables, outfolder: str, gff: bool = False, faa: bool = False) -> api.GenomeTables:
    """built, written to outfolder and read back from there."""
    genome_db.write_tables(built.tables(), outfolder)
    found = read_db(built.orfs.sparkSession, outfolder)
    if gff:
        sinks.write_lines(sinks.gff_lines(found.orfs, found.contigs), f"{outfolder}/gff")
    if faa:
        sinks.write_lines(sinks.faa_lines(found.orfs, found.contigs), f"{outfolder}/faa")
    return found


def read_db(spark: SparkSession, path: str) -> api.GenomeTables:
    """Genome tables under path, or those of a binary database file."""
    if os.path.splitext(path)[1]:
        decoded = settled(genome_db.read_binary(spark, path), "decoded")
        return api.GenomeTables(**genome_db.tables_of(decoded))
    return api.GenomeTables(**genome_db.read_tables(spark, path), path=path.rstrip("/"))


def dist(queries: api.GenomeTables, refs: api.GenomeTables | None = None, is_self: bool | None = None, min_aai: float = 0.01, preset: str = DEFAULT_PRESET["api"], **options) -> DataFrame:
    """Score rows with a preset's shape and sampling and otherwise the library's defaults or options (fields of DistParams).

    is_self: whether each pair is compared once; as it is where refs are left out.
    """
    once = refs is None if is_self is None else is_self
    return api.dist(queries, None if once else (refs or queries), api_params(preset, min_aai=min_aai, **options))
