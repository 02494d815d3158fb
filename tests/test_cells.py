"""Pairs of genomes formed in kernels, chunk against chunk, held against plain Python."""

from collections import defaultdict
from itertools import product
from math import sqrt

import numpy as np
import pytest

from genoweave.operators import cells, chain, joins
from genoweave.plans import api
from genoweave.plans.presets import DistParams

SEEDS = "genome string, hash32 bigint, seg_idx bigint, aa_pos int, n_occ bigint, occ int"


@pytest.fixture
def tiny(monkeypatch):
    """Many chunks, and few shared hashes at once."""
    for name, value in (("CHUNK_SEEDS", 30), ("CHUNK_GENOMES", 3), ("HELD", 16), ("ROWS", 7)):
        monkeypatch.setattr(cells, name, value)


def made(seed=3, genomes=("a", "b", "é", "Z", "a1", "10", "9", "x" * 40, "c", "d", "e")):
    """Seeds with up to nine occurrences of a hash, by genome and hash."""
    rng, out = np.random.default_rng(seed), {}
    for g in genomes:
        for h in rng.choice([*range(14), (1 << 32) - 1], 9, replace=False).tolist():
            places = sorted({(int(s), int(p)) for s, p in zip(rng.integers(0, 4, 9), rng.integers(0, 30, 9), strict=True)})
            out[g, h] = places[: int(rng.choice([1, 1, 1, 2, 3, 9]))]
    return out


def frame(spark, seeds):
    return spark.createDataFrame([(g, h, s, p, len(x), k) for (g, h), x in seeds.items() for k, (s, p) in enumerate(x)], SEEDS)


def plain(queries, refs, mode, most, least=2):
    """Of each pair: n_shared, cap, n_anchors and anchors (q_seg, r_seg, q_pos, r_pos, weight)."""
    names = [sorted({g for g, _ in x}) for x in (queries, refs)]
    out = {}
    for q, r in product(*names):
        if mode == "triangle" and q >= r or mode == "ordered" and q == r:
            continue
        both = [(queries[q, h], refs[r, h]) for g, h in queries if g == q and (r, h) in refs]
        cost = [sum(min(len(a), c) * min(len(b), c) for a, b in both) for c in range(1, 9)]
        if cost[7] < least:
            continue
        cap = max([c for c in range(1, 9) if not most or cost[c - 1] <= most], default=1)
        spread = lambda x: [x[i * len(x) // min(len(x), cap)] for i in range(min(len(x), cap))]  # noqa: B023, E731
        found = sorted((a[0], b[0], a[1], b[1], float(np.float32(1 / sqrt(len(x) * len(y))))) for x, y in both for a in spread(x) for b in spread(y))
        out[q, r] = (len(both), cap, cost[cap - 1], found)
    return out


@pytest.mark.parametrize(("mode", "most"), [("triangle", 12), ("triangle", 0), ("ordered", 20), ("cross", 20)])
def test_pairs_of_chunks_equal_plain_python(spark, tiny, mode, most):
    queries = made()
    refs = made(5) if mode == "cross" else queries
    own = frame(spark, queries)
    other = frame(spark, refs) if mode == "cross" else own
    want, params = plain(queries, refs, mode, most), DistParams(max_pair_matches=most)
    got = {(x.q, x.r): (x.n_shared, x.cap, x.n_anchors) for x in cells.pair_budgets(own, other, mode, params).collect()}
    assert got == {k: v[:3] for k, v in want.items()} and len({v[1] for v in want.values()}) > (most > 0)
    found = defaultdict(list)
    for x in cells.anchors(own, other, mode, params).collect():
        found[x.q, x.r].append((x.q_seg, x.r_seg, x.q_pos, x.r_pos, x.weight))
    assert {k: sorted(v) for k, v in found.items()} == {k: v[3] for k, v in want.items()}
    sums = {(x.q, x.r): (x.n, x.places, round(x.weight, 6)) for x in cells.anchor_sums(own, other, mode, params).collect()}
    assert sums == {k: (len(v[3]), sum(a[2] + 3 * a[3] for a in v[3]), round(sum(a[4] for a in v[3]), 6)) for k, v in want.items()}
    shared = {(x.q, x.r): x.n_shared for x in cells.shared_counts(own, other, mode).collect()}
    assert shared == {k: v[0] for k, v in plain(queries, refs, mode, 0, 1).items()}
    # the same pairs by Spark's join of rows
    joined = joins.pair_budgets(joins.shared_hashes(own, other, mode), params)
    assert got == {(x.q, x.r): (x.n_shared, x.cap, x.n_anchors) for x in joined.collect()}
    counts = joins.anchors(own, other, mode, params).groupBy("q", "r", "q_seg", "r_seg").count().withColumnRenamed("count", "score")
    assert sorted(map(tuple, joins.reciprocal_best(counts).collect())) == sorted(map(tuple, cells.best_orf_pairs(own, other, mode, params).collect()))


def test_two_tables_by_name(spark, tiny):
    """Modes by name hold for two tables as well, which share some names."""
    queries, refs = made(), made(7, ("a", "Z", "b2", "é", "0"))
    for mode in ("triangle", "ordered"):
        want = plain(queries, refs, mode, 0)
        got = cells.pair_budgets(frame(spark, queries), frame(spark, refs), mode, DistParams(max_pair_matches=0)).collect()
        assert {(x.q, x.r): (x.n_shared, x.cap, x.n_anchors) for x in got} == {k: v[:3] for k, v in want.items()}


def test_nothing_that_grows_with_the_pairs_is_shuffled(spark):
    """Hashes that pairs share were rows of a join once, written and shuffled."""
    own = frame(spark, made())
    for found in (cells.shared_counts(own, own, "triangle"), cells.anchor_sums(own, own, "triangle", DistParams()), cells.best_orf_pairs(own, own, "triangle", DistParams())):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.replace("BroadcastHashJoin", "").replace("BroadcastNestedLoopJoin", "") and "Aggregate" not in plan
    empty = own.where("false")
    assert cells.shared_counts(empty, empty, "triangle").count() == 0


@pytest.mark.parametrize("together", [0, 24])
def test_chains_of_chunks_equal_chains_of_rows(spark, tiny, monkeypatch, together):
    """Many ORF pairs are chained together, long ones apart; a row holds the same chains as one of anchors' rows."""
    monkeypatch.setattr(chain, "TOGETHER", together)
    own, params = frame(spark, made(11)), DistParams(max_pair_matches=0)
    want = chain.chains(joins.anchors(own, own, "triangle", params), params).collect()
    got = chain.paired_chains(own, own, "triangle", params)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) > 100
    short = chain.paired_chains(own, own, "triangle", params, anchors=False)
    assert short.columns == got.columns[:-1] and sorted(map(str, short.collect())) == sorted(map(str, got.drop("anchors").collect()))


def test_many_chains_at_once():
    rng = np.random.default_rng(1)
    for n, reach in ((2, 50), (3, 2), (9, 4), (20, 50)):
        q = np.sort(rng.integers(0, 60, (40, n)), axis=1)
        r, w = rng.integers(0, 60, (40, n)), rng.random((40, n)).astype(np.float32)
        row, score, size, path = chain.best_chains_of_many(q, r, w, reach, 25, 30, 2)
        end, got = np.cumsum(size), defaultdict(list)
        for k in range(len(row)):
            got[int(row[k])].append((float(score[k]), path[end[k] - size[k] : end[k]].tolist()))
        for k in range(40):
            assert sorted(got[k], key=lambda x: (-x[0], x[1][0])) == chain.best_chains(q[k], r[k], w[k], reach, 25, 30, 2)


def test_covered_chains_of_chunks_equal_those_of_rows(spark, tiny):
    own, params = frame(spark, made(13)), DistParams(max_pair_matches=0, min_orf_cov=0.4)
    orfs = own.select("genome", "seg_idx").distinct().selectExpr("*", "cast(40 + 3 * seg_idx + length(genome) as int) AS aa_len")
    want = chain.covered(chain.chains(joins.anchors(own, own, "triangle", params), params), orfs, params)
    got = api.covered_chains(own, own, orfs, orfs, "triangle", params)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and 0 < want.count() < chain.paired_chains(own, own, "triangle", params).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_chains_of_best_orf_pairs_are_chosen_in_the_kernel(spark, tiny, share):
    """All covered chains were rows once, written and shuffled for the choice of ORF pairs that are each other's best."""
    own, params = frame(spark, made(17)), DistParams(max_pair_matches=0, min_orf_cov=share)
    orfs = own.select("genome", "seg_idx").distinct().selectExpr("*", "cast(40 + 3 * seg_idx + length(genome) as int) AS aa_len")
    every = chain.covered(chain.chains(joins.anchors(own, own, "triangle", params), params), orfs, params)
    want = every.join(api.best_pairs(every, params), chain.PAIR, "left_semi")
    got = api.covered_chains(own, own, orfs, orfs, "triangle", params, best=True)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and 0 < want.count() < every.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


def test_best_orf_pairs_with_ties():
    ref, q, r = np.array([0, 0, 0, 0, 1, 1]), np.array([1, 1, 2, 2, 1, 2]), np.array([5, 6, 5, 6, 5, 5])
    assert chain.mutual_best(ref, q, r, np.array([3, 3, 3, 3, 1, 2], np.float32)).tolist() == [True, False, False, False, False, True]
    assert chain.mutual_best(ref, q, r, np.array([3, 4, 3, 1, 2, 2], np.float32)).tolist() == [False, True, False, False, True, False]
    assert not len(chain.mutual_best(*np.zeros((4, 0))))


def test_gene_calling_reads_letters_for_lengths_once(spark, monkeypatch):
    """Windows' and stop rates' lengths come from a written table, not from the contigs' letters."""
    rng = np.random.default_rng(2)
    contigs = spark.createDataFrame([(g, 0, "c", "".join(rng.choice(list("ACGT"), 900))) for g in "ab"], "genome string, contig_idx int, contig string, seq string")
    seen = []
    rate = api.coding.stop_rate
    monkeypatch.setattr(api.coding, "stop_rate", lambda runs, sizes: seen.append(sizes.columns) or rate(runs, sizes))
    built = api.build(contigs)
    assert "seq" not in seen[0] and "seq" not in built.contigs.columns
    assert [(x.genome, x.length, x.offset) for x in built.contigs.orderBy("genome").collect()] == [("a", 900, 0), ("b", 900, 0)]
    assert rate(api.orfs.run_lengths(contigs), contigs).orderBy("genome").collect() == rate(api.orfs.run_lengths(contigs), built.contigs).orderBy("genome").collect()
