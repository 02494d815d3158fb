"""The function API, the command line's options, sinks and the seed cache."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from genoweave.plans import api, cli, library
from genoweave.plans.presets import DistParams, GeneParams, api_params
from genoweave.plans.schemas import schema
from genoweave.plans.store import numbered
from genoweave.sources import genome_db, sinks

CODONS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")]


def gene(rng, n):
    return "ATG" + "".join(rng.choice(CODONS) for _ in range(n)) + "TAA"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("fastas")
    rng = random.Random(3)
    same = "".join(gene(rng, 80) for _ in range(2))
    for name, genome in (("one", same), ("two", same), ("three", gene(rng, 120)), ("zero", gene(rng, 110))):
        (at / f"{name}.fna").write_text(f">c1 x\n{genome}\n>c2\n{genome[:200]}\n")
    return str(at)


@pytest.fixture(scope="module")
def db(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("db"))
    cli.main(["build_db", "--infolder", folder, "--outfolder", out, "--no-coding-filter", "--gff-out", "--faa", "--binary", "--verbose"], spark)
    return out


def test_numbers_are_printed_as_c_prints_them(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -2.5, 1 / 128, 3 / 128, 1 / 640, 2.750025, 0.00137525, 999999.4, 1e6, 123456789.0, 9.87654e-05, 1e-4, 0.5, 1000.125, 1000.375, 2.0**53, -0.0078125, 1e-12]
    values += [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-8, 9) for _ in range(300)] + [rng.randint(0, 10**5) / rng.choice((64, 128, 640, 1024)) for _ in range(300)]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", sinks.fixed(F.col("v"), 6).alias("f"), sinks.six_digits(F.col("v")).alias("g")).collect()
    assert {values[r.k]: r.f for r in got} == {v: f"{v:.6f}" for v in values}
    assert {values[r.k]: r.g for r in got} == {v: f"{v:g}" for v in values}


def test_numbered_follows_the_order(spark):
    rows = spark.createDataFrame([(f"g{k:03}",) for k in random.Random(2).sample(range(500), 300)], "genome string")
    got = [(r.place, r.genome) for r in numbered(rows, "genome", "place").collect()]
    assert sorted(got) == list(enumerate(sorted(g for _, g in got)))
    assert numbered(rows.where("false"), "genome", "place").count() == 0


def test_cache_follows_its_source(spark, tmp_path):
    source, keep, made = str(tmp_path / "source"), str(tmp_path / "keep"), []

    def table(n):
        def make():
            made.append(n)
            return spark.range(n)

        return sinks.cached_table(spark, keep, "k", make, source).count()

    spark.range(5).write.parquet(source)
    assert table(5) == 5 and table(6) == 5
    spark.range(9).write.mode("overwrite").parquet(source)
    assert table(7) == 7 and made == [5, 7]
    assert not [p.name for p in (tmp_path / "keep" / "k").iterdir() if p.name.startswith(".new")]


def test_command_line_options(spark, db, tmp_path, caplog):
    kept, out = str(tmp_path / "kept"), str(tmp_path / "out")
    args = ["dist", "-q", db, "-r", db + "/", "--small-sensitive", "--temp-dir", kept, "--output", out, "--no-triangle"]
    with caplog.at_level("INFO", "genoweave"):
        cli.main(args, spark)
    assert "12 pairs, 10 filtered, 2 passed" in caplog.text
    rows = spark.read.option("sep", "\t").option("header", "true").csv(out).collect()
    assert {(r["query"], r["ref"]) for r in rows} == {("one", "two"), ("two", "one")} and len(rows[0]) == 14
    tables = list((tmp_path / "kept").iterdir())
    assert len(tables) == 1
    cli.main(args, spark)
    assert [len(list(t.iterdir())) for t in tables] == [1]
    search = ["search", "-q", db, "--preset", "small-sensitive", "--marker-factor", "1", "--marker-shape", "4:0,1,3,4", "-n", "1", "--exclude-self", "--output", out]
    cli.main(search, spark)
    rows = spark.read.option("sep", "\t").option("header", "true").csv(out).collect()
    assert {(r["query"], r["ref"], r["aai"]) for r in rows} == {("one", "two", "1.000000"), ("two", "one", "1.000000")} and len(rows[0]) == 17
    assert rows[0].asDict().keys() >= {"shared_markers", "marker_excess", "marker_containment"}
    cli.main([*search, "--containment-only"], spark)
    assert spark.read.option("sep", "\t").option("header", "true").csv(out).columns == ["query", "ref", "shared_markers", "marker_excess", "marker_containment", "query_markers", "ref_markers"]


def test_command_line_refuses(spark, db, tmp_path):
    with pytest.raises(SystemExit, match="no such folder"):
        cli.main(["dist", "-q", str(tmp_path / "none"), "-r", db], spark)
    with pytest.raises(SystemExit):
        cli.main(["dist", "-q", db, "--small-fast", "--med-fast"], spark)
    with pytest.raises(SystemExit, match="one folder"):
        cli.main(["dist", "-q", db, "-r", str(tmp_path), "--no-triangle"], spark)
    with pytest.raises(RuntimeError, match="pyrodigal"):
        library.build_db(spark, seq="ACGT" * 30, method="pyrodigal")
    with pytest.raises(ValueError, match="unknown method"):
        library.build_db(spark, seq="ACGT", method="other")


def test_a_binary_file_for_each_genome(spark, db, tmp_path):
    found = library.read_db(spark, db)
    assert [p.rsplit("/", 1)[1] for p in genome_db.listed(spark, db + "/binary")] == ["one.gdb", "three.gdb", "two.gdb", "zero.gdb"]
    again = library.read_db(spark, db + "/binary/one.gdb")
    for name in ("contigs", "orfs", "genomes"):
        own, other = found.tables()[name].where("genome = 'one'"), again.tables()[name]
        columns = sorted(own.columns)
        assert sorted(map(tuple, own.select(columns).collect())) == sorted(map(tuple, other.select(columns).collect()))
    genomes = spark.createDataFrame([("a/b", 3, 0, 0), ("a:b", 4, 0, 0)], schema("genomes"))
    contigs = spark.createDataFrame([("a/b", 0, "c", 0, 3)], "genome string, contig_idx int, contig string, offset bigint, length bigint")
    files = genome_db.write_binary(genomes, contigs, spark.createDataFrame([], schema("orfs")), str(tmp_path / "x"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a_b-2.gdb", "a_b.gdb"]
    assert {(r.genome, r.nuc_length, len(r.contigs), len(r.orfs)) for r in genome_db.read_binary(spark, str(tmp_path / "x")).collect()} == {("a/b", 3, 1, 0), ("a:b", 4, 0, 0)}


def test_orfs_called_elsewhere(spark):
    contigs = spark.createDataFrame([("g", 0, "c0", "A" * 100), ("g", 1, "c1", "A" * 50)], schema("contigs"))
    calls = spark.createDataFrame([("g", 0, 105, "MKU*"), ("g", 3, 0, "MKVL"), ("g", 1, 6, "AAAA"), ("g", 1, 150, "MM")], "genome string, frame int, nuc_start bigint, protein string")
    built = api.from_calls(contigs, calls)
    assert [(r.seg_idx, r.contig_idx, r.nuc_start, r.protein) for r in built.orfs.orderBy("seg_idx").collect()] == [(0, 0, 0, "MKVL"), (1, 0, 6, "AAAA"), (2, 1, 105, "MKC")]
    row = built.genomes.first()
    assert (row.nuc_length, row.coding_nuc, row.n_orfs) == (150, 27, 3)

    def finder(seq):
        yield 1, True, "MKVL*"
        yield 5, False, "MK"

    built = api.build(contigs, GeneParams(min_orf=3), finder)
    assert [(r.contig_idx, r.frame, r.nuc_start, r.protein) for r in built.orfs.orderBy("seg_idx").collect()] == [(0, 0, 0, "MKVL"), (1, 0, 100, "MKVL")]


def test_library_calls(spark, db):
    rng = random.Random(5)
    seq = gene(rng, 200)
    found = library.find_genes(spark, seq, params=GeneParams(coding_filter=False)).collect()
    assert any(r.nuc_start == 0 and r.protein.startswith("M") and r.aa_len >= 200 for r in found)
    stages = library.find_genes_stages(spark, seq)
    sizes = {k: v.count() for k, v in stages.items()}
    assert sizes["orfs"] == sizes["features"] >= sizes["select"] == sizes["final"] and sizes["summary"] == 1
    assert 0 <= stages["summary"].first().coding_density <= 1
    tables = library.read_db(spark, db)
    rows = library.dist(tables, preset="small-sensitive").collect()
    assert [(r["query"], r.ref) for r in rows] == [("one", "two")]
    assert library.dist(tables, is_self=False, preset="small-sensitive").count() == 6
    own = api_params("small-sensitive", min_aai=0.5)
    assert (own.min_aai, own.min_orf_cov, own.min_chain_aligned_aa, own.max_pair_matches, own.scaled) == (0.5, 0.2, 20, 0, 2)


def test_counters(spark, db):
    seen = Observation("pairs")
    api.dist(library.read_db(spark, db), None, DistParams(shape="4:0,1,3,4", scaled=1, min_aai=0.99), "ordered", None, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"candidates": 12, "passed": 2}
