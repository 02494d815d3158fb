"""Pairs of ORFs by all of their anchors: no budget for a pair and no cap for a side."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_cells import frame, made

import __spark_entry__ as contract
from genoweave import queries
from genoweave.operators import cells


def plain(queries, refs, mode, least):
    """(q, r, q_seg, r_seg, score) by plain loops over every occurrence with every one."""
    score = Counter()
    for (q, h), x in queries.items():
        for (r, k), y in refs.items():
            if h == k and not (mode == "triangle" and q >= r or mode == "ordered" and q == r):
                score.update((q, r, a[0], b[0]) for a in x for b in y)
    total, of_q, of_r = Counter(), {}, {}
    for (q, r, a, b), n in score.items():
        total[q, r] += n
        of_q[q, r, a], of_r[q, r, b] = max(of_q.get((q, r, a), (0, 0)), (n, -b)), max(of_r.get((q, r, b), (0, 0)), (n, -a))
    return sorted((*k, float(n)) for k, n in score.items() if total[k[:2]] >= least and of_q[k[:3]] == (n, -k[3]) and of_r[k[0], k[1], k[3]] == (n, -k[2]))


@pytest.mark.parametrize("mode", ["triangle", "ordered", "cross"])
@pytest.mark.parametrize("table", [1 << 22, 0])
def test_best_pairs_of_all_anchors_equal_plain_loops(spark, monkeypatch, mode, table):
    for name, value in (("CHUNK_SEEDS", 30), ("CHUNK_GENOMES", 3), ("HELD", 16), ("ROWS", 7), ("TABLE", table)):
        monkeypatch.setattr(cells, name, value)
    own_seeds = made(23)
    refs = made(29) if mode == "cross" else own_seeds
    own = frame(spark, own_seeds)
    other = frame(spark, refs) if mode == "cross" else own
    for least in (2, 60):
        want = plain(own_seeds, refs, mode, least)
        assert sorted(map(tuple, cells.best_of_all_anchors(own, other, mode, least).collect())) == want and want


def test_j05_counts_every_anchor(spark, tmp_path):
    """A pair's anchors ended at 40 once, and a side's occurrences at 8."""
    import duckdb

    rng = np.random.default_rng(4)
    lines = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 400)) for _ in range(4)]
    texts = ["\n".join(lines), "\n".join(lines[::-1]), "\n".join([lines[1], lines[1], lines[2]]), None, ""]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = sorted(map(tuple, contract.queries()["j05_reciprocal_best"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    assert got == sorted(duck.execute(contract.oracle_sql()["j05_reciprocal_best"]).fetchall())
    assert sum(x[4] for x in got if x[:2] == ("0", "1")) > 100


@pytest.mark.parametrize(("name", "columns"), [("j01_shared_hashes", ()), ("j03_pair_budgets", ("n",)), ("j02_anchors", ("pos",)), ("j05_reciprocal_best", ("seg",))])
def test_seeds_are_dealt_once_and_chunks_hold_what_is_read(spark, monkeypatch, name, columns):
    """Seeds were written and shuffled twice once, and every chunk held places that j01 and j03 don't read."""
    written, write = [], cells.settled
    monkeypatch.setattr(cells, "settled", lambda df, tag: written.append((tag, df)) or write(df, tag))
    monkeypatch.setattr(queries, "settled", lambda df, tag: pytest.fail(f"{tag} are written"))
    contract.queries()[name](spark, "/root/testdata/sf0.001")
    ((tag, rows),) = written
    assert tag == "chunks" and rows._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    for x in rows.collect():
        side = cells.Side(x.names, bytes(x.data), columns)
        assert len(side.hash) and all(hasattr(side, c) == (c in columns) for c in cells.EVERY)


def test_c02_writes_no_seeds(spark, monkeypatch):
    monkeypatch.setattr(queries, "settled", lambda df, tag: pytest.fail(f"{tag} are written"))
    assert contract.queries()["c02_chains"](spark, "/root/testdata/sf0.001").count()
