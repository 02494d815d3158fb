"""Hand-built genomes from sequence to score row."""

import random

import pytest
from pyspark.sql import functions as F

from genoweave.functions.constants import AMINO
from genoweave.operators import joins, orfs, seeds
from genoweave.operators.intervals import union_length
from genoweave.operators.joins import reciprocal_best
from genoweave.plans import api
from genoweave.plans.presets import DistParams, GeneParams, SearchParams, dist_params
from genoweave.plans.schemas import schema
from genoweave.sources import fasta, genome_db, sinks


def contigs(spark, *rows):
    return spark.createDataFrame([(g, i, f"c{i}", s) for g, i, s in rows], schema("contigs"))


def tables(spark, proteins):
    rows = [(g, k, 0, 0, 0, len(p), p) for g, many in proteins.items() for k, p in enumerate(many)]
    found, start = [], {}
    for g, k, c, f, _, n, p in rows:
        found.append((g, k, c, f, start.get(g, 0), n, p))
        start[g] = start.get(g, 0) + 3 * n
    table = spark.createDataFrame(found, schema("orfs"))
    genomes = spark.createDataFrame([(g, n, n, len(proteins[g])) for g, n in start.items()], schema("genomes"))
    return api.GenomeTables(genomes, genomes.select("genome"), table)


def protein(rng, n):
    return "".join(rng.choice(AMINO) for _ in range(n))


def test_golden_seeds(spark):
    table = spark.createDataFrame([("g", 0, "MKVLAARNDC")], "genome string, seg_idx bigint, protein string")
    got = {r.aa_pos: (r.kmer, r.hash32) for r in seeds.raw_seeds(table, "4:0,1,3,4", 1).collect()}
    assert got[0] == (100600, 4110178820) and got[3] == (80022, 1585203360) and got[4] == (43, 77256213)
    assert got[1][1] == 1188146485 and got[2][1] == 1032187643 and got[5][1] == 2890264640
    assert {r.aa_pos for r in seeds.raw_seeds(table, "4:0,1,3,4", 2).collect()} == {0, 3, 4}
    six = {r.aa_pos: r.hash32 for r in seeds.raw_seeds(table, "6:0,2,3,4,5,6", 12).collect()}
    assert six == {1: 3621539111, 3: 1618245853}


def test_mask(spark):
    rng = random.Random(1)
    unit = protein(rng, 12)
    for times, kept in ((5, 5), (6, 0)):
        table = spark.createDataFrame([("g", k, unit[:8]) for k in range(times)], "genome string, seg_idx bigint, protein string")
        assert seeds.extract_seeds(table, "8:0,1,2,3,4,5,6,7", 1, max_occ=5).count() == kept


def test_frames(spark):
    body = "GCC" * 40
    df = contigs(spark, ("open", 0, body), ("closed", 0, "TAA" + body + "TAG"), ("split", 0, body + "N" + body), ("tiny", 0, "AC"))
    got = orfs.orf_candidates(df).where("frame = 0").groupBy("genome").agg(F.collect_list("aa_len").alias("n")).collect()
    lengths = {r.genome: sorted(r.n) for r in got}
    assert lengths["open"] == [40] and lengths["closed"] == [40]
    runs = {r.genome for r in orfs.run_lengths(df).where("aa_len = 40").collect()}
    assert "closed" in runs and "open" not in runs and "split" not in runs
    assert "tiny" not in lengths


def test_reverse_strand_gives_the_same_protein(spark):
    rng = random.Random(4)
    codons = [c for c in (a + b + d for a in "ACGT" for b in "ACGT" for d in "ACGT") if c not in ("TAA", "TAG", "TGA")]
    gene = "ATG" + "".join(rng.choice(codons) for _ in range(60))
    turned = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = contigs(spark, ("f", 0, gene), ("r", 0, turned))
    out = {}
    for r in orfs.proteins(orfs.trimmed(orfs.orf_candidates(df, GeneParams(30)))).collect():
        out.setdefault(r.genome, set()).add((r.protein, r.start if r.genome == "f" else len(gene) - r.start - 3 * r.aa_len))
    assert {p for p, _ in out["f"]} == {p for p, _ in out["r"]}


def test_short_contigs_skip_the_filter(spark):
    df = contigs(spark, ("g", 0, "ATG" + "GCC" * 60))
    assert api.called_orfs(df).where("not keep").count() == 0
    built = api.build(df, GeneParams(coding_filter=False))
    assert built.genomes.first().nuc_length == 183


def test_union(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 20, 30), ("a", 22, 25), ("a", 9, 9)], "k string, start bigint, end bigint")
    assert union_length(df, ["k"]).first().covered == 18


def test_reciprocal_ties(spark):
    rows = [("a", "b", 0, 0, 5.0), ("a", "b", 0, 1, 5.0), ("a", "b", 1, 0, 5.0), ("a", "b", 1, 1, 5.0), ("a", "b", 2, 1, 9.0)]
    got = reciprocal_best(spark.createDataFrame(rows, "q string, r string, q_seg int, r_seg int, score double")).collect()
    assert {(x.q_seg, x.r_seg) for x in got} == {(0, 0), (2, 1)}


def test_identical_genomes_and_a_stranger(spark):
    rng = random.Random(9)
    many = [protein(rng, 120) for _ in range(4)]
    worn = ["".join(c if rng.random() > 0.15 else rng.choice(AMINO) for c in p) for p in many]
    found = tables(spark, {"a": many, "b": many, "c": worn, "d": [protein(rng, 100)]})
    params = DistParams(shape="4:0,1,3,4", scaled=1, min_orf_cov=0.1)
    rows = {(r["query"], r.ref): r for r in api.dist(found, None, params).collect()}
    same = rows["a", "b"]
    assert same.aai == 1 and same.matched_orfs == 4 and same.orf_hit == 1
    assert same.chaining_genome_coverage == pytest.approx(1) and same.composite_score == pytest.approx(1)
    near = rows["a", "c"]
    assert 0.75 < near.aai < 0.95 and near.composite_score <= 1
    assert not any("d" in k for k in rows)
    # both directions of a comparison agree up to the query-driven details
    turned = {(r["query"], r.ref): r for r in api.dist(found, None, params, mode="ordered").collect()}
    assert turned["c", "a"].aai == pytest.approx(near.aai, abs=0.05)


def test_search(spark):
    rng = random.Random(2)
    families = {f"g{k}": [protein(rng, 150) for _ in range(3)] for k in range(6)}
    for k in range(6):
        families[f"h{k}"] = ["".join(c if rng.random() > 0.05 else rng.choice(AMINO) for c in p) for p in families[f"g{k}"]]
    found = tables(spark, families)
    params = SearchParams(marker_shape="4:0,1,3,4", factor=1, exclude_self=True, top=1)
    dist = dist_params(None, shape="4:0,1,3,4", scaled=1, min_orf_cov=0.1)
    best = {r["query"]: r.ref for r in api.search_genomes(found, None, dist, params).collect()}
    assert all(best[f"g{k}"] == f"h{k}" and best[f"h{k}"] == f"g{k}" for k in range(6))


def test_fasta(spark, tmp_path):
    (tmp_path / "one.fna").write_bytes(b">c1 first contig\r\nacgu\r\nNNAC\r\n>c2\tx\nTT>TT\n>empty\n>last\nACG")
    (tmp_path / "two.FA").write_bytes(b">x\nAC\n>y\nACGT\n")
    (tmp_path / "none.txt").write_text(">z\nACGT\n")
    (tmp_path / "nil.fa").write_text("")
    got = sorted((r.genome, r.contig_idx, r.contig, r.seq) for r in fasta.fasta_folder(spark, str(tmp_path)).collect())
    assert got == [("one", 0, "c1", "ACGUNNAC"), ("one", 1, "c2", "TT>TT"), ("one", 2, "empty", ""), ("one", 3, "last", "ACG"), ("two", 0, "x", "AC"), ("two", 1, "y", "ACGT")]
    records = {r.genome for r in fasta.fasta_records(spark, str(tmp_path / "two.FA")).collect()}
    assert records == {"y"}  # a short record is left out, what follows it stays


def test_large_fasta_is_numbered_by_blocks(spark, tmp_path):
    names = [f"c{k}" for k in range(400)]
    (tmp_path / "big.fna").write_text("junk before\n" + "".join(f">{n}\n{'ACGT' * 20}\n" for n in names))
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in usual:
            spark.conf.set(k, "4k")
        found = fasta.fasta_folder(spark, str(tmp_path))
        assert [r.contig for r in sorted(found.collect(), key=lambda r: r.contig_idx)] == names
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_search_forms_chosen_pairs_only(spark):
    """Seeds of either side meet only by hashes that a chosen pair shares: no join of all seeds by hash alone."""
    rows = [(g, h, g, h, 1, 0) for g in ("a", "b", "c", "d") for h in range(40)]
    own = spark.createDataFrame([(g, h, 0, p, n, o) for g, h, _, p, n, o in rows], "genome string, hash32 bigint, seg_idx bigint, aa_pos int, n_occ int, occ int")
    chosen = spark.createDataFrame([("a", "b")], "q string, r string")
    found = joins.shared_hashes(own, own, "cross", chosen)
    assert {(r.q, r.r) for r in found.collect()} == {("a", "b")} and found.count() == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "q#" not in line and "r#" not in line]
    got = joins.anchors(own, own, "cross", DistParams(), chosen)
    assert {(r.q, r.r) for r in got.select("q", "r").distinct().collect()} == {("a", "b")} and got.count() == 40


def test_binary_database(spark, tmp_path):
    orf = [(0, 0, 4, "MKVL"), (4, 20, 3, "ARN")]
    (tmp_path / "g.db").write_bytes(genome_db.encode("g", 100, 21, [("c0", 0, 18), ("c1", 18, 82)], orf))
    decoded = genome_db.read_binary(spark, str(tmp_path))
    row = decoded.first()
    assert (row.genome, row.nuc_length, row.coding_nuc) == ("g", 100, 21)
    got = [(r.seg_idx, r.contig_idx, r.frame, r.nuc_start, r.aa_len, r.protein) for r in genome_db.orfs_of(decoded).orderBy("seg_idx").collect()]
    assert got == [(0, 0, 0, 0, 4, "MKVL"), (1, 1, 4, 20, 3, "ARN")]
    with pytest.raises(ValueError, match="rebuilt"):
        genome_db.decode(b"XXXXXDB\0" + b"\0" * 40)
    with pytest.raises(ValueError, match="not a genome database"):
        genome_db.decode(b"XXXXXDB1" + b"\0" * 40)


def test_sinks_and_cache(spark, tmp_path):
    found = spark.createDataFrame([("g", 0, 0, 0, 6, 4, "MKVL"), ("g", 1, 0, 4, 0, 3, "ARN")], schema("orfs"))
    at = spark.createDataFrame([("g", 0, "c", 0)], "genome string, contig_idx int, contig string, offset bigint")
    lines = [r.line for r in sinks.gff_lines(found, at).orderBy("k").collect()]
    assert lines == ["##gff-version 3", "c\tgenoweave\tCDS\t7\t18\t.\t+\t0\tID=orf_1", "c\tgenoweave\tCDS\t1\t9\t.\t-\t0\tID=orf_2"]
    heads = [r["head"] for r in sinks.faa_lines(found, at).orderBy("k").collect()]
    assert heads == [">c_1 # 1 # 9 # -1 # ID=1_1", ">c_2 # 7 # 18 # 1 # ID=1_2"]
    made = []

    def make():
        made.append(1)
        return found

    for _ in range(2):
        assert sinks.cached_table(spark, str(tmp_path / "cache"), sinks.cache_key("p", "4:0,1,3,4", 2, 1, 0, 0), make).count() == 2
    assert made == [1]
    assert sinks.printed(spark.createDataFrame([(1.5,)], "x double")).first().x == "1.500000"
