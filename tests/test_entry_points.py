"""The command line and the stream, from files to results."""

import random

from genoweave.plans import cli
from genoweave.streaming.ingest import ingest


def gene(rng, n):
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")]
    return "ATG" + "".join(rng.choice(codons) for _ in range(n)) + "TAA"


def write_genomes(folder):
    rng = random.Random(7)
    genome = "".join(gene(rng, 90) for _ in range(2))
    for name in ("one", "two"):
        (folder / f"{name}.fna").write_text(f">c1 x\n{genome}\n")


def test_command_line(spark, tmp_path):
    fastas = tmp_path / "in"
    fastas.mkdir()
    write_genomes(fastas)
    db, out = str(tmp_path / "db"), str(tmp_path / "out")
    cli.main(["build_db", "--infolder", str(fastas), "--outfolder", db, "--no-coding-filter", "--gff"], spark)
    assert spark.read.text(f"{db}/gff").where("value like '##gff%'").count() == 2
    cli.main(["dist", "--query", db, "--shape", "4:0,1,3,4", "-c", "1", "--out", out], spark)
    rows = spark.read.option("sep", "\t").option("header", "true").csv(out).collect()
    assert [(r["query"], r["ref"], r["aai"]) for r in rows] == [("one", "two", "1.000000")] and len(rows[0]) == 14


def test_stream(spark, tmp_path):
    fastas = tmp_path / "in"
    fastas.mkdir()
    write_genomes(fastas)
    query = ingest(spark, str(fastas), str(tmp_path / "tables"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    genomes = spark.read.parquet(str(tmp_path / "tables/genomes"))
    assert {r.genome for r in genomes.collect()} == {"one", "two"} and genomes.first().n_orfs > 0
