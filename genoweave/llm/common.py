"""Helpers shared by the training-data operators: shared-folder tables, hot keys, text folding, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import settled as materialize
from ..plans.store import tidy as tidy

#: A word is a maximal run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot when it holds over one in HOT of all rows; so there are at most HOT hot keys, whatever the input.
HOT = 1024


def join_repeated(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys(on, n, ...), written tables: one row per key, n at most its rows. Hot keys, at most ``HOT``, are broadcast."""
    total = rows.count()
    hot = keys.where(F.col("n") * HOT > total)
    settled = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col("n") * HOT <= total), on)
    return settled.unionByName(rest)


def fold_az(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII text takes the byte-wise lower(), which is the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
