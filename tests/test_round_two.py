"""Findings of the second round: what each would have failed on before."""

import math

import numpy as np

from genoweave.functions import sequence
from genoweave.functions.constants import CODON_SHARE
from genoweave.llm import passages
from genoweave.operators import coding, orfs
from genoweave.plans import api, store
from genoweave.plans.presets import GeneParams
from genoweave.plans.schemas import schema


def test_measures_are_summed_in_turn():
    """As the SQL sums them: a period-3 signal that is 2 there is no less here, and none differs in its last bit."""
    rng = np.random.default_rng(3)
    tied = [[13, 8, 7], [8, 17, 17], [3, 6, 7], [16, 9, 9]], [[16, 18, 7], [7, 7, 13], [9, 4, 10], [8, 11, 10]]
    for counts in (*map(np.array, tied), *(np.stack([rng.multinomial(100, [0.28, 0.24, 0.24, 0.24]) for _ in range(3)], 1) for _ in range(50))):
        codes = np.empty(3 * int(counts[:, 0].sum()), np.uint8)
        for p in range(3):
            codes[p::3] = np.repeat(np.arange(4), counts[:, p])
        spread = chance = known = own = 0.0
        n = float(counts.sum())
        for b in range(4):
            base = float(counts[b].sum())
            for p in range(3):
                spread += (float(counts[b, p]) - base / 3) ** 2
                known += float(counts[b, p]) * math.log(float(CODON_SHARE[b, p]))
            chance += base / n * (1 - base / n)
            own += base * math.log((base + 0.5) / (n + 2))
        assert sequence.snr(codes) == 1.5 * spread / (n * chance)
        assert sequence.composition_score(codes) == (known - own) / n


def test_long_texts_are_sent_in_small_batches(spark, monkeypatch):
    """op6's kernels hold few texts at once; the session's own batch size is back afterwards."""
    usual = spark.conf.get(store.BATCH)

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    out = store.settled(spark.range(2000, numPartitions=1).mapInArrow(kernel, "n long"), "sizes", passages.TEXTS)
    sizes = [r.n for r in out.collect()]
    assert sum(sizes) == 2000 and max(sizes) <= passages.TEXTS
    assert spark.conf.get(store.BATCH) == usual
    asked = {}
    monkeypatch.setattr(passages, "materialize", lambda df, tag, batch_rows=None: asked.update({tag: batch_rows}) or store.settled(df, tag, batch_rows))
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(1, text), (2, "other start " + text)], "doc_id bigint, text string")
    assert {r.doc_id: r.removed_chars for r in passages.without_passages(docs).collect()} == {1: 0, 2: len(text)}
    assert asked["anchors"] == asked["runs"] == passages.TEXTS


def made_contigs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        body = np.frombuffer(b"ACGTN", np.uint8)[rng.choice(5, 6000 + k, p=[0.31, 0.22, 0.3, 0.169, 0.001])].copy()
        for at in range(300, 5000, 700):  # stop-free stretches, some behind a ribosome site
            body[at : at + 330] = np.frombuffer(b"AGGAGGAACAACATG" + b"GCCGAAGGT" * 35, np.uint8)[:330]
        rows.append((f"g{k // 2}", k % 2, f"c{k}", body.tobytes().decode()))
    return spark.createDataFrame([*rows, ("nil", 0, "c", ""), ("short", 0, "c", "ACGTA")], schema("contigs")), rows


def test_frames_are_measured_together(spark):
    """Measures of all frames of a contig at once are, to the last bit, those of each frame alone."""
    df, rows = made_contigs(spark)
    texts = {(g, k): sequence.encode(s) for g, k, _, s in rows}
    found = orfs.orf_candidates(df).collect()
    assert len(found) > 200 and {r.frame >= 3 for r in found} == {True, False} and max(r.site for r in found) >= 5
    for r in found:
        codes = texts[r.genome, r.contig_idx]
        own = codes[r.start : r.start + 3 * r.aa_len]
        strand, five = codes, r.start
        if r.frame >= 3:
            own, strand, five = sequence.reverse_complement(own), sequence.reverse_complement(codes), len(codes) - (r.start + 3 * r.aa_len)
        assert (r.snr, r.psi, r.site) == (sequence.snr(own), sequence.composition_score(own), sequence.site_score(strand, five))
        assert (sequence.encode(r.nt) == own).all() and len(r.nt) == 3 * r.aa_len


def test_hexamers_of_frames_are_not_made_rows(spark):
    """Scores of the whole genome's frames against a plain count, and a plan without a join or a row a hexamer."""
    df, _ = made_contigs(spark)
    params = GeneParams(window=10**9)
    scored = coding.hexamer_scores(orfs.orf_spans(df), df, params)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
    pairs = {}
    for r in coding.dicodons(orfs.in_order(orfs.orf_candidates(df))).collect():
        pairs.setdefault((r.genome, r.seg_idx), []).append((r.hexamer, r.m))
    back = {(r.genome, r.hexamer): r.n for r in orfs.background_hexamers(df, params).collect()}
    own = {}
    for (g, _), many in pairs.items():
        for h, m in many:
            own[g, h] = own.get((g, h), 0) + m
    c_total, b_total = ({g: sum(n for (x, _), n in t.items() if x == g) for g in ("g0", "g1", "g2")} for t in (own, back))
    got = {(r.genome, r.seg_idx): r.d for r in scored.collect()}
    assert got.keys() == pairs.keys()
    for (g, k), many in pairs.items():
        d = sum(m * math.log2((own[g, h] + 1) / (c_total[g] + 4096) / ((back.get((g, h), 0) + 1) / (b_total[g] + 4096))) for h, m in many) / sum(m for _, m in many)
        assert abs(got[g, k] - d) < 1e-9
    assert api.called_orfs(df).where("keep and d <> 0").count() > 0


def test_genomes_without_training_frames_are_not_dealt(spark, monkeypatch):
    df, _ = made_contigs(spark)
    seen = []
    real = coding._by_genome
    monkeypatch.setattr(coding, "_by_genome", lambda frames, *rest: seen.append(frames) or real(frames, *rest))
    plain = df.where("genome = 'g0'").selectExpr("'plain' AS genome", "contig_idx", "contig", "repeat('ACGT', 300) AS seq")
    found = orfs.in_order(orfs.orf_candidates(df.unionByName(plain)))
    rows = {r.genome: r.d for r in coding.scored(found, df.unionByName(plain)).groupBy("genome").agg({"d": "max"}).withColumnRenamed("max(d)", "d").collect()}
    dealt = {r.genome for r in seen[0].select("genome").distinct().collect()}
    assert rows["plain"] == 0 and "plain" not in dealt and dealt and all(rows[g] != 0 for g in dealt)


def test_driver_gives_back_native_memory_as_tables_are_written(spark, monkeypatch):
    """The pipeline's many small plans left the driver's JVM with freed memory that it held."""
    asked, real = [], store.trimmed
    monkeypatch.setattr(store, "trimmed", lambda s: asked.append(real(s)))
    for _ in range(2 * store.TRIM_EVERY):
        store.settled(spark.range(3), "few")
    assert len(asked) == 2 and all(isinstance(x, str) for x in asked)
