"""Schemas of the engine's tables. Unsigned 32- and 64-bit quantities are bigint."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType}

DDL = {
    "contigs": "genome string, contig_idx int, contig string, seq string",
    "orfs": "genome string, seg_idx bigint, contig_idx int, frame int, nuc_start bigint, aa_len int, protein string",
    "genomes": "genome string, nuc_length bigint, coding_nuc bigint, n_orfs bigint",
    "seeds": "genome string, hash32 bigint, seg_idx bigint, aa_pos int, nlogp int",
    "anchors": "q string, r string, q_seg bigint, r_seg bigint, q_pos int, r_pos int, weight float",
    "chains": "q string, r string, q_seg bigint, r_seg bigint, q_min int, q_max int, r_min int, r_max int, n_matches int, score float, anchors array<struct<q_pos:int,r_pos:int>>",
    "hsps": "q string, r string, q_seg bigint, r_seg bigint, q_len int, r_len int, score int, matches int, aligned int, q_beg int, q_end int, r_beg int, r_end int, evalue double, match_pos array<int>, align_pos array<int>",
}


def _split(text: str) -> list[str]:
    """At commas outside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, _, t in (x.partition(":") for x in _split(text[7:-1]))])
    return _SIMPLE[text]()


def parsed(ddl: str) -> T.StructType:
    """A schema from "name type, ..." without a session."""
    return T.StructType([T.StructField(n, _type(t.strip())) for n, _, t in (x.partition(" ") for x in _split(ddl))])


def schema(name: str) -> T.StructType:
    return parsed(DDL[name])
