"""The screen of a search: pairs of genomes are formed in lists, not as rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoweave.operators import search, seeds
from genoweave.plans.presets import SearchParams

PARAMS = SearchParams(candidates=4, top=2, max_posting=6, background=5, exclude_self=True)


def _marks():
    rng = np.random.default_rng(7)
    return {f"g{i:02d}": set(rng.choice(40, int(rng.integers(3, 14)), replace=False).tolist()) | ({100} if i % 3 else set()) | ({70_000 + i // 2} if i % 4 else set()) for i in range(24)} | {"none": set()}


def _expected(marks, params):
    """Ranked candidates by plain loops: (q, r, shared, excess, cont, rank)."""
    names = sorted(marks)
    nr, ns = len(names), min(len(names), params.background)
    drawn = [names[(k * nr + nr // 2) // ns] for k in range(ns)]
    batch = {g: i // params.batch_refs if params.batch_refs else 0 for i, g in enumerate(names)}
    held = Counter((batch[g], h) for g in names for h in marks[g])
    posts = {g: {h for h in marks[g] if held[batch[g], h] <= params.max_posting} for g in names}

    def middle(values):
        return sorted(values)[len(values) // 2] if values else 0.0

    lam = {g: middle([len(marks[g] & marks[s]) / len(marks[s]) for s in drawn if s != g and marks[s]]) for g in names}

    def value(g, s):
        least = min(len(marks[s]), len(marks[g]))
        return np.float32((len(posts[g] & marks[s]) - lam[s] * len(marks[g])) / least if least else 0.0)

    back = {g: middle([value(g, s) for s in drawn if s != g]) for g in names}
    out = []
    for q in names:
        rows = []
        for rid, r in enumerate(names):
            x = (n := len(marks[q] & posts[r])) - lam[q] * len(marks[r])
            if n and x > 0 and q != r:
                rows.append((rid, r, n, np.float32(x), np.float32(x / min(len(marks[q]), len(marks[r])) - float(back[r]))))
        turns = {}
        for turn, c in ((0, 3), (1, 4)):
            for place, row in enumerate(sorted(rows, key=lambda x: (-x[c], x[0]))[: params.candidates], 1):
                turns[row] = min(turns.get(row, 99), 2 * place + turn)
        out += [(q, row[1], row[2], float(row[3]), float(row[4]), k) for k, row in enumerate(sorted(turns, key=turns.get)[: params.candidates], 1)]
    return sorted(out)


@pytest.mark.parametrize(("batch_refs", "held", "sent"), [(0, None, None), (7, None, None), (0, 0, 0)])
def test_candidates_against_plain_loops(spark, monkeypatch, batch_refs, held, sent):
    if held is not None:  # sizes and backgrounds travel with the lists, and nothing is broadcast
        monkeypatch.setattr(search, "SENT_ROWS", sent)
        monkeypatch.setattr(search.ranked_candidates, "__defaults__", (False, held))
    marks = _marks()
    params = SearchParams(**{**PARAMS.__dict__, "batch_refs": batch_refs})
    genomes = spark.createDataFrame([(g,) for g in marks], "genome string")
    rows = spark.createDataFrame([(g, h) for g in marks for h in marks[g]], "genome string, hash32 bigint")
    found = search.candidates(genomes, rows, genomes, rows, params)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(x) for x in found.select("q", "r", "shared", "excess", "cont", "rank").collect()) == _expected(marks, params)


def test_background_makes_no_row_for_each_reference_and_sample(spark):
    marks = _marks()
    rows = spark.createDataFrame([(g, h) for g in marks for h in marks[g]], "genome string, hash32 bigint")
    refs = search.numbered_refs(spark.createDataFrame([(g,) for g in marks], "genome string"), rows)
    sample = search.background_sample(refs, 5)
    own = rows.join(sample.select("genome"), "genome", "left_semi")
    found = search.ref_background(rows, refs, sample, own, sample.select("genome", F.lit(0.0).alias("lam")))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert found.count() == len(marks) and "collect_list(value" not in plan


def test_marker_hashes_are_those_of_the_masked_seeds(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, "".join(rng.choice(list("ACDE"), 90))) for i in range(12)] + [("b", 0, "ACDEFGHIKL" * 9), ("c", 0, "")]
    orfs = spark.createDataFrame(rows, "genome string, seg_idx bigint, protein string")
    for shape, cut in (("4:0,1,3,4", 0), ("4:0,1,3,4", 3), ("4:0,1,2,3;0,1,3,4", 0)):
        own = seeds.marker_hashes(orfs, shape, 1, cut)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, search.markers(seeds.extract_seeds(orfs, shape, 1, cut)).collect())) != []


def test_comparison_of_chosen_pairs_reads_no_other_genome(spark):
    from genoweave.plans import api
    from genoweave.plans.presets import dist_params

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("ARNDCQEGHILKMFPSTWYV"), 120)) for _ in range(3)]
    rows = [(g, i, 0, 0, 360 * i, 120, p) for g in "abcd" for i, p in enumerate(base)]
    orfs = spark.createDataFrame(rows, "genome string, seg_idx bigint, contig_idx int, frame int, nuc_start bigint, aa_len int, protein string")
    genomes = spark.createDataFrame([(g, 1080, 1080, 3) for g in "abcd"], "genome string, nuc_length bigint, coding_nuc bigint, n_orfs bigint")
    every = api.GenomeTables(genomes, genomes.select("genome"), orfs)
    chosen = spark.createDataFrame([("a", "b"), ("a", "c")], "q string, r string")
    params = dist_params(None, shape="4:0,1,3,4", scaled=1)
    for queries, own in ((every, {"a", "b", "c"}), (api.limited(every, genomes.where("genome = 'a'").select("genome")), {"a"})):
        found = api.compared(queries, every, params, "cross", chosen)
        assert {r.genome for r in found["seeds"].select("genome").distinct().collect()} == own
        got = {(r["query"], r.ref): (r.aai, r.matched_orfs) for r in found["dist"].collect()}
        assert got == {("a", "b"): (1.0, 3), ("a", "c"): (1.0, 3)}
