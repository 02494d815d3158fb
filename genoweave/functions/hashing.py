"""The 64-bit finaliser used for sampling, as numpy and as native columns, and FNV-1a."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the finaliser and of FNV-1a.
M1, M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK64 = (1 << 64) - 1


def fmix64(x: np.ndarray) -> np.ndarray:
    """The finaliser over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(M1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(M2)
    return x ^ (x >> np.uint64(33))


def fmix64_int(x: int) -> int:
    x ^= x >> 33
    x = x * M1 & MASK64
    x ^= x >> 33
    x = x * M2 & MASK64
    return x ^ (x >> 33)


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK64
    return h


def sample_threshold(scaled: int) -> int:
    """Hashes up to this one, inclusive and unsigned, are kept at a rate of one in ``scaled``."""
    return MASK64 // scaled


def _limb(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _folded(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def with_fmix64(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the finaliser of a bigint column, as a bit pattern. 16-bit limbs keep every product in range under ANSI arithmetic."""
    x, t = f"__{out}_x", f"__{out}_t"
    df = df.withColumn(x, _folded(F.col(value)))
    for k in (M1, M2):
        limbs = [(k >> (16 * i)) & 0xFFFF for i in range(4)]
        carry = None
        parts = []
        for i in range(4):
            total = sum((_limb(F.col(x), j) * limbs[i - j] for j in range(i + 1)), F.lit(0).cast("long"))
            name = f"{t}{i}"
            df = df.withColumn(name, total if carry is None else total + F.shiftrightunsigned(F.col(carry), 16))
            carry = name
            parts.append(F.shiftleft(F.col(name).bitwiseAND(F.lit(0xFFFF)).cast("long"), 16 * i))
        product = parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])
        df = df.withColumn(x, product).withColumn(x, _folded(F.col(x))).drop(*(f"{t}{i}" for i in range(4)))
    return df.withColumnRenamed(x, out)
