"""Golden vectors computed from the formulas, and native columns against the plain functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoweave.functions import hashing, sequence, statistics
from genoweave.operators.seeds import occurrence_cut, orf_hash, packed, unpacked
from genoweave.plans.presets import api_params, dist_params, parse_shape, search_params


def test_finaliser():
    got = hashing.fmix64(np.array([0, 1, 2, 3199999], np.uint64))
    assert got.tolist() == [0, 12994781566227106604, 4233148493373801447, 5415880817838656803]
    assert [hashing.fmix64_int(x) for x in (0, 1, 2, 3199999)] == got.tolist()
    assert got[1] & 0xFFFFFFFF == 885181228


def test_native_finaliser(spark):
    values = [0, 1, 2, 3199999, -1, -(2**63), 2**63 - 1, 123456789012345]
    rows = hashing.with_fmix64(spark.createDataFrame([(v,) for v in values], "value bigint"), "value", "h").collect()
    expected = hashing.fmix64(np.array(values, np.int64).view(np.uint64)).view(np.int64).tolist()
    assert [r.h for r in rows] == expected


@pytest.mark.parametrize("seq, value", [("ATG" * 10, 15.0), ("ACGT" * 9, 0.0), ("ATGGCC" * 10, 9.230769), ("ATGATG", 0.0)])
def test_snr(seq, value):
    assert sequence.snr(sequence.encode(seq)) == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("lengths, expected", [((100, 120), (61.883246, 81.883246)), ((300, 300), (244.268886, 244.268886))])
def test_effective_lengths(lengths, expected):
    assert statistics.effective_lengths(*lengths) == pytest.approx(expected, abs=1e-5)


def test_evalues(spark):
    cases = [(50, 100, 120, 3.309182e-4), (40, 300, 300, 5.626717e-2), (30, 30, 40, 1.243068e-2), (60, 1000, 500, 1.812666e-3), (0, 10, 10, 1e30)]
    for score, m, n, e in cases:
        assert statistics.evalue(score, m, n) == pytest.approx(e, rel=1e-5)
    df = spark.createDataFrame([c[:3] for c in cases], "s int, m int, n int")
    got = [r[0] for r in df.select(statistics.evalue_column(F.col("s"), F.col("m"), F.col("n"))).collect()]
    assert got == pytest.approx([c[3] for c in cases], rel=1e-5)
    assert statistics.sum_evalue([35, 38], 100, 120) == pytest.approx(6.525654e-4, rel=1e-5)
    assert statistics.sum_evalue([20, 20], 300, 300) == 1e30
    pooled = spark.createDataFrame([([35, 38], 100, 120), ([20, 20], 300, 300), ([], 50, 50)], "s array<int>, m int, n int")
    got = [r[0] for r in pooled.select(statistics.sum_evalue_column(F.col("s"), F.col("m"), F.col("n"))).collect()]
    assert got == pytest.approx([6.525654e-4, 1e30, 1e30], rel=1e-5)


def test_occurrence_cut(spark):
    import math

    values = [0.001, 0.1, 0.5, 1, 10, 1000]
    stored = [max(0, min(65535, int(-256 * math.log(v) + 0.5))) if v < 1 else 0 for v in values]
    rows = spark.createDataFrame([(s,) for s in stored], "x int").select(occurrence_cut(F.col("x")).cast("int")).collect()
    assert [r[0] for r in rows] == [2, 2, 3, 5, 5, 5]


def test_shapes_and_presets():
    assert parse_shape("6:0,2,3,4,5,6").span == 7
    assert len(parse_shape("4:0,1,3,4;0,1,2;0,2,3,5").patterns) == 2
    with pytest.raises(ValueError):
        parse_shape("4:0,1")
    assert dist_params("med-normal").scaled == 8
    assert dist_params("med-normal", scaled=10).scaled == 8  # equals the default, so the preset wins
    assert dist_params("med-normal", scaled=11).scaled == 11
    assert dist_params("small-ultra").min_chain_seeds == 3
    own = api_params("large-normal")
    assert (own.scaled, own.max_evalue, own.min_orf_cov, own.min_aligned) == (8, 0.1, 0.2, 30)
    assert search_params("xl-fast").factor == 1024 and search_params("small-fast", top=30).candidates == 30


def test_packing_round_trip():
    for text in ("", "A", "MKVLAARNDC", "ARNDCQEGHILKMFPSTWYV*" * 3):
        assert len(packed(text)) == -(-5 * len(text) // 8)
        assert unpacked(packed(text), len(text)) == text
    assert orf_hash("g", "MKVL", 0) != orf_hash("g", "MKVL", 1)


def test_native_sequence_functions(spark):
    df = spark.createDataFrame([("atgUUNacg", "MKU*")], "s string, p string")
    row = df.select(sequence.encoded(F.col("s")).alias("e"), sequence.sanitised(F.col("p")).alias("p")).first()
    assert (row.e, row.p) == ("ATGTTNACG", "MKC")
    nt = spark.createDataFrame([("ATGAAATAA",)], "s string").select(sequence.translated(F.col("s")).alias("p"), sequence.reverse_complemented(F.col("s")).alias("r")).first()
    assert (nt.p, nt.r) == ("MK*", "TTATTTCAT")
    numbers = sequence.codons(sequence.encode("ATGAAATAA"))
    assert sequence.translate(numbers) == "MK*"
