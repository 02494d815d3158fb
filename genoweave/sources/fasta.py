"""FASTA sources: a folder of genomes, a file of many genomes, sequences in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.schemas import schema

#: Extensions of genome files, in either case.
EXTENSIONS = ("fa", "fna", "fasta", "faa", "fas")
MIN_RECORD = 3


def _in_block() -> F.Column:
    """Place, from 0, among the records of one block of a file: numbering is the work of a task for each block."""
    return F.row_number().over(Window.partitionBy("file", "block").orderBy("order")) - 1


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, order, head, seq of every record. Files are split at line-initial ">" by the text reader, so a large file is many tasks.

    block is where the record's split begins in the file, order its place among the rows read from it.
    """
    suffix = "(?i)\\.(" + "|".join(EXTENSIONS) + ")$"
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    raw = raw.where(F.col("file").rlike(suffix))
    # only the first record of a file still has its mark; what stands before a first mark is no record
    first = F.col("value").startswith(">")
    raw = raw.withColumn("start", (F.col("block") == 0) & (_in_block() == 0)).where(~F.col("start") | first)
    text = F.when(F.col("start"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    line = F.regexp_extract(text, r"^([^\n]*)", 1)
    head = F.regexp_extract(line, r"^([^ \t\r]*)", 1)
    body = F.regexp_replace(F.substring(text, F.length(line) + 1, F.lit(2**31 - 1)), r"[\r\n \t]", "")
    return raw.select("file", "block", "order", head.alias("head"), F.upper(body).alias("seq"))


def _stem(file: F.Column) -> F.Column:
    return F.regexp_replace(F.url_decode(F.regexp_extract(file, r"([^/]*)$", 1)), r"\.[^.]*$", "")


def fasta_folder(spark: SparkSession, path: str) -> DataFrame:
    """contigs: each file a genome named by its stem, each record a contig in file order."""
    rows = _records(spark, path)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    placed = rows.withColumn("k", _in_block()).join(blocks, ["file", "block"])
    return placed.select(_stem(F.col("file")).alias("genome"), (F.col("ahead") + F.col("k")).cast("int").alias("contig_idx"), F.col("head").alias("contig"), "seq")


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """contigs: each record a genome of its own; records under three letters are left out, the others stay."""
    rows = _records(spark, path).where(F.length("seq") >= MIN_RECORD)
    return rows.select(F.col("head").alias("genome"), F.lit(0).alias("contig_idx"), F.col("head").alias("contig"), "seq")


def in_memory(spark: SparkSession, sequences: list[tuple[str, str]] | str, name: str = "genome") -> DataFrame:
    """contigs of one genome: a sequence, or (contig name, sequence) pairs; upper-cased."""
    pairs = [(name, sequences)] if isinstance(sequences, str) else sequences
    return spark.createDataFrame([(name, i, c, s.upper()) for i, (c, s) in enumerate(pairs)], schema("contigs"))
