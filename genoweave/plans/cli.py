"""Command line: build_db, dist and search over FASTA inputs and table folders."""

from __future__ import annotations

import argparse
import logging
import time
from contextlib import contextmanager

from pyspark.sql import Observation, SparkSession

from ..sources import fasta, genome_db, sinks
from . import api, library
from .presets import DEFAULT_PRESET, NAMES, GeneParams, dist_params, search_params

VERSION = "0.2"
log = logging.getLogger("genoweave")


def _options(one: argparse.ArgumentParser, output: str) -> None:
    """What dist and search share. Options left out have no value here: presets and defaults are applied in presets.py."""
    one.add_argument("-q", "--qdbfolder", "--query", dest="query", required=True, help="folder of the queries' genome tables")
    one.add_argument("-r", "--rdbfolder", "--ref", dest="ref", help="folder of the references' tables; the queries' folder, or none, compares them among themselves")
    preset = one.add_mutually_exclusive_group()
    preset.add_argument("--preset", choices=NAMES)
    for name in NAMES:
        preset.add_argument(f"--{name}", dest="preset", action="store_const", const=name)
    one.add_argument("--shape", help="seed shape in place of the preset's")
    one.add_argument("-c", "--scaled", type=int, help="one in c seeds")
    one.add_argument("--min-aai", type=float)
    one.add_argument("--min-orf-cov", type=float)
    one.add_argument("--min-chain-seeds", type=int)
    one.add_argument("--xdrop", type=int)
    one.add_argument("--max-evalue", type=float)
    one.add_argument("--temp-dir", default="", help="shared folder that keeps seed tables for later runs; none are kept without it")
    one.add_argument("--output", "--out", dest="out", default=output, help="folder of the result's tab-separated parts")


def _threads(one: argparse.ArgumentParser) -> None:
    one.add_argument("--threads", type=int, help="tasks at once in local mode; a cluster has its own settings")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="genoweave")
    top.add_argument("-v", "--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build_db", help="FASTA to genome tables")
    source = build.add_mutually_exclusive_group(required=True)
    source.add_argument("--infasta", help="one file, each record a genome")
    source.add_argument("--infolder", help="a folder, each file a genome")
    build.add_argument("--outfolder", default="called_fastas")
    build.add_argument("--method", choices=library.METHODS, default="native", help="gene finder")
    build.add_argument("--min-orf", type=int, default=30)
    build.add_argument("--window", type=int, default=300)
    build.add_argument("--no-coding-filter", action="store_true")
    build.add_argument("--gff-out", "--gff", dest="gff", action="store_true")
    build.add_argument("--faa", action="store_true")
    build.add_argument("--binary", action="store_true", help="one binary database a genome, too")
    build.add_argument("--verbose", action="store_true", help="log each genome's figures")
    _threads(build)
    one = sub.add_parser("dist", help="score rows of all pairs")
    _options(one, "db_distances.tsv")
    one.add_argument("-g", "--gene-scaled", type=int)
    one.add_argument("--min-matched-orfs", type=int)
    one.add_argument("--max-pair-matches", type=int)
    one.add_argument("--aggressive-filter", action="store_true", default=None)
    one.add_argument("--no-triangle", action="store_true", help="both directions; only of one folder with itself")
    _threads(one)
    one = sub.add_parser("search", help="the closest references of each query")
    _options(one, "search_results.tsv")
    one.add_argument("-n", "--top-n", "--top", dest="top", type=int, default=1)
    one.add_argument("-k", "--candidates", type=int)
    one.add_argument("--marker-factor", dest="factor", type=int, help="one in F marker seeds")
    one.add_argument("--marker-shape")
    one.add_argument("--max-posting", type=int)
    one.add_argument("--batch-refs", type=int)
    one.add_argument("--exclude-self", action="store_true", default=None)
    one.add_argument("--containment-only", action="store_true")
    _threads(one)
    return top


_DIST = ("shape", "scaled", "min_aai", "min_orf_cov", "min_chain_seeds", "xdrop", "max_evalue", "gene_scaled", "min_matched_orfs", "max_pair_matches", "aggressive_filter")
_SEARCH = ("top", "candidates", "factor", "marker_shape", "max_posting", "batch_refs", "exclude_self")


def _given(args: argparse.Namespace, names: tuple[str, ...]) -> dict:
    return {n: getattr(args, n) for n in names if getattr(args, n, None) is not None}


@contextmanager
def _interruptible(spark: SparkSession, name: str):
    """Jobs of one command form a group, which an interrupt from the keyboard cancels."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    except KeyboardInterrupt:
        spark.sparkContext.cancelJobGroup(name)
        raise


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    params = GeneParams(args.min_orf, args.window, not args.no_coding_filter)
    if args.infolder:
        found = library.build_db_folder(spark, args.infolder, args.outfolder, args.method, args.gff, args.faa, params)
    else:
        found = library.kept(api.build(fasta.fasta_records(spark, args.infasta), params, library._caller(args.method)), args.outfolder, args.gff, args.faa)
    if args.binary:
        genome_db.write_binary(**found.tables(), folder=f"{args.outfolder}/binary")
    if args.verbose:
        for row in found.genomes.orderBy("genome").toLocalIterator():
            log.info("%s: %d ORFs, %d of %d nucleotides coding", row.genome, row.n_orfs, row.coding_nuc, row.nuc_length)
    log.info("built %d genomes (%s)", found.genomes.count(), args.method)


def _compare(spark: SparkSession, args: argparse.Namespace) -> None:
    alone = args.ref is None or args.ref.rstrip("/") == args.query.rstrip("/")
    if getattr(args, "no_triangle", False) and not alone:
        raise SystemExit("--no-triangle compares one folder with itself")
    queries, refs = library.read_db(spark, args.query), None if alone else library.read_db(spark, args.ref)
    cache = args.temp_dir or None
    if args.command == "dist":
        counters = Observation("pairs")
        mode = "ordered" if args.no_triangle else "triangle"
        sinks.write_tsv(api.dist(queries, refs, dist_params(args.preset, **_given(args, _DIST)), mode, cache, counters), args.out)
        seen = counters.get
        log.info("%d pairs, %d filtered, %d passed to %s", seen["candidates"], seen["candidates"] - seen["passed"], seen["passed"], args.out)
        return
    preset = args.preset or DEFAULT_PRESET["search"]
    chosen = search_params(preset, **_given(args, _SEARCH))
    sinks.write_tsv(api.search_genomes(queries, refs, dist_params(preset, **_given(args, _DIST)), chosen, args.containment_only, cache), args.out)
    log.info("%s: at most %d candidates a query, markers %s one in %d, to %s", preset, chosen.candidates, chosen.marker_shape, chosen.factor, args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("genoweave")
    spark = spark or (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    began = time.time()
    with _interruptible(spark, args.command):
        (_build if args.command == "build_db" else _compare)(spark, args)
    log.info("%s took %.1f s", args.command, time.time() - began)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    main()
