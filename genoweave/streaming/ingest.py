"""Incremental ingestion: FASTA files that arrive in a folder are called once each and appended to the genome tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import api
from ..plans.presets import GeneParams


def arriving_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of contigs rows, one genome per file; files are read whole, so a file is one task."""
    from ..sources.fasta import EXTENSIONS, _stem

    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}").load(folder)
    rows = files.select(_stem(F.col("_metadata.file_path")).alias("genome"), F.posexplode(F.split(F.concat(F.lit("\n"), "value"), r"\n>")).alias("at", "record")).where("at > 0")
    line = F.regexp_extract("record", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.substring(F.col("record"), F.length(line) + 1, F.lit(2**31 - 1)), r"[\r\n \t]", "")
    return rows.select("genome", (F.col("at") - 1).alias("contig_idx"), F.regexp_extract(line, r"^([^ \t\r]*)", 1).alias("contig"), F.upper(body).alias("seq"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, params: GeneParams = GeneParams()) -> StreamingQuery:
    """Call the genomes of every new file; each batch's tables are written under its own id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        built = api.build(batch, params)
        for name, table in built.tables().items():
            table.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={batch_id}")

    return arriving_contigs(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
