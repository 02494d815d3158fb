"""Genome databases: Parquet tables of the engine, and a reader and writer of the compact binary layout.

The binary layout is little-endian: magic; name; length; coding length; contigs (name, offset, length); ORFs (frame, start,
length); residues at five bits, each ORF padded to a byte.
"""

from __future__ import annotations

import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from ..plans.schemas import parsed
from ..plans.store import settled

from ..operators.seeds import packed, unpacked

#: Any eight bytes that end in this mark; those that end in the older mark, without a number before a zero, need a rebuild.
MARK, OLD_MARK = b"DB2", b"DB\0"
DECODED = parsed(
    "genome string, nuc_length bigint, coding_nuc bigint, contigs array<struct<contig:string,offset:bigint,length:bigint>>, "
    "orfs array<struct<frame:int,nuc_start:bigint,aa_len:int,protein:string>>"
)
#: Characters of a genome's name that become "_" in its file's.
UNSAFE = r'[/\\:*?"<>|]'


def encode(name: str, nuc_length: int, coding_nuc: int, contigs: list[tuple[str, int, int]], orfs: list[tuple[int, int, int, str]], magic: bytes = b"GENOWDB2") -> bytes:
    raw = name.encode()
    out = [magic, struct.pack("<H", len(raw)), raw, struct.pack("<QQI", nuc_length, coding_nuc, len(contigs))]
    for contig, offset, length in contigs:
        raw = contig.encode()
        out += [struct.pack("<H", len(raw)), raw, struct.pack("<QQ", offset, length)]
    out.append(struct.pack("<Q", len(orfs)))
    out += [struct.pack("<BQH", frame, start, aa_len) for frame, start, aa_len, _ in orfs]
    out += [packed(protein) for *_, protein in orfs]
    return b"".join(out)


def decode(data: bytes, headers: bool = True):
    """(name, nuc_length, coding_nuc, contigs, orfs); without headers the ORF list stays empty and residues unread."""
    if data[:8].endswith(OLD_MARK):
        raise ValueError("a database of the older layout must be rebuilt")
    if not data[:8].endswith(MARK):
        raise ValueError("not a genome database")
    at = 8

    def take(fmt: str):
        nonlocal at
        values = struct.unpack_from("<" + fmt, data, at)
        at += struct.calcsize("<" + fmt)
        return values

    def text() -> str:
        nonlocal at
        (n,) = take("H")
        at += n
        return data[at - n : at].decode()

    name = text()
    nuc_length, coding_nuc, n_contigs = take("QQI")
    contigs = [(text(), *take("QQ")) for _ in range(n_contigs)]
    (n_orfs,) = take("Q")
    if not headers:
        return name, nuc_length, coding_nuc, contigs, []
    heads = [take("BQH") for _ in range(n_orfs)]
    orfs = []
    for frame, start, aa_len in heads:
        size = -(-5 * aa_len // 8)
        orfs.append((frame, start, aa_len, unpacked(data[at : at + size], aa_len)))
        at += size
    return name, nuc_length, coding_nuc, contigs, orfs


def read_binary(spark: SparkSession, path: str, headers: bool = True) -> DataFrame:
    """One row per binary database: genome, nuc_length, coding_nuc, contigs, orfs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                name, length, coding, contigs, orfs = decode(value.as_py(), headers)
                row = {
                    "genome": [name], "nuc_length": [length], "coding_nuc": [coding],
                    "contigs": [[dict(zip(("contig", "offset", "length"), c, strict=True)) for c in contigs]],
                    "orfs": [[dict(zip(("frame", "nuc_start", "aa_len", "protein"), o, strict=True)) for o in orfs]],
                }
                from pyspark.sql.pandas.types import to_arrow_schema

                yield pa.RecordBatch.from_pydict(row, schema=to_arrow_schema(DECODED))

    return files.mapInArrow(run, DECODED)


def orfs_of(decoded: DataFrame) -> DataFrame:
    """orfs table of read_binary's rows; seg_idx is the order in the file, contig_idx the last contig that starts before the ORF."""
    rows = decoded.select("genome", "contigs", F.posexplode("orfs").alias("seg_idx", "o"))
    at = F.size(F.filter("contigs", lambda c: c["offset"] <= F.col("o.nuc_start"))) - 1
    return rows.select("genome", F.col("seg_idx").cast("bigint").alias("seg_idx"), at.alias("contig_idx"), "o.frame", "o.nuc_start", "o.aa_len", "o.protein")


FILES = parsed("genome string, path string, n_bytes bigint")


def encoded_rows(genomes: DataFrame, contigs: DataFrame, orfs: DataFrame) -> DataFrame:
    """genome, file (its safe name; names that become alike get a number), nuc_length, coding_nuc, contigs, orfs: a row a genome."""
    at = contigs.groupBy("genome").agg(F.transform(F.array_sort(F.collect_list(F.struct("contig_idx", "contig", "offset", "length"))), lambda c: F.struct(c["contig"], c["offset"], c["length"])).alias("contigs"))
    calls = orfs.groupBy("genome").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "frame", "nuc_start", "aa_len", "protein"))), lambda o: F.struct(o["frame"], o["nuc_start"], o["aa_len"], o["protein"])).alias("orfs"))
    safe = F.regexp_replace("genome", UNSAFE, "_")
    rows = genomes.select("genome", "nuc_length", "coding_nuc", safe.alias("safe")).join(at, "genome", "left").join(calls, "genome", "left")
    alike = F.row_number().over(Window.partitionBy("safe").orderBy("genome"))
    file = F.when(alike > 1, F.concat_ws("-", "safe", alike.cast("string"))).otherwise(F.col("safe"))
    return rows.withColumn("file", file).select("genome", "file", "nuc_length", "coding_nuc", "contigs", "orfs")


def write_binary(genomes: DataFrame, contigs: DataFrame, orfs: DataFrame, folder: str, extension: str = "gdb") -> DataFrame:
    """One file a genome in the compact layout, in a folder all executors share; returns genome, path, n_bytes of what was written.

    Executors write their own genomes aside and rename them, so that a repeated task replaces its files and none is ever seen in part.
    """

    def run(batches):
        import uuid

        from pyarrow import fs as filesystems

        where = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
        fs, root = filesystems.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                cells = [tuple(c.values()) for c in row["contigs"] or []]
                data = encode(row["genome"], row["nuc_length"], row["coding_nuc"], cells, [tuple(o.values()) for o in row["orfs"] or []])
                path = f"{root.rstrip('/')}/{row['file']}.{extension}"
                aside = f"{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as out:
                    out.write(data)
                fs.move(aside, path)
                done.append((row["genome"], path, len(data)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=FILES.names)

    return settled(encoded_rows(genomes, contigs, orfs).mapInArrow(run, FILES), "files")


def require_folder(spark: SparkSession, path: str) -> str:
    """path, or an exit with its name if no such folder is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise SystemExit(f"no such folder: {path}")
    return path


def listed(spark: SparkSession, path: str, extension: str = "gdb") -> list[str]:
    """The binary databases of a folder, sorted by path; names only."""
    require_folder(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
    return [r.path for r in files.select("path").orderBy("path").toLocalIterator()]


def tables_of(decoded: DataFrame) -> dict[str, DataFrame]:
    """genomes, contigs and orfs of read_binary's rows."""
    places = decoded.select("genome", F.posexplode("contigs").alias("contig_idx", "c")).select("genome", "contig_idx", "c.contig", "c.length", "c.offset")
    genomes = decoded.select("genome", "nuc_length", "coding_nuc", F.size("orfs").cast("bigint").alias("n_orfs"))
    return {"genomes": genomes, "contigs": places, "orfs": orfs_of(decoded)}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """genomes, contigs and orfs as Parquet, ORFs laid out by genome."""
    for name, df in tables.items():
        out = df.repartition("genome").sortWithinPartitions("genome") if name == "orfs" else df
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    require_folder(spark, path)
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("genomes", "contigs", "orfs")}
