import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.special import chisq_upper, unrank
from kinfold.operators import blocks, dating, differentiation, frequencies, fstats, graphs, haplotypes, models, relatedness, structure


def test_chisq_upper():
    assert chisq_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chisq_upper(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert chisq_upper(0, 3) == 1 and math.isnan(chisq_upper(1, 0))


def test_unrank():
    assert [tuple(r) for r in unrank(np.arange(math.comb(8, 4)), 8, 4)] == list(itertools.combinations(range(8), 4))


def counts(spark, rows):
    return spark.createDataFrame(rows, "snp_idx long, pop string, n long, ac long, het long")


def test_wc_anchors(spark):
    c = counts(spark, [(1, "A", 2, 4, 0), (1, "B", 2, 0, 0), (2, "A", 2, 2, 2), (2, "B", 2, 2, 2)])
    r = {x.snp_idx: x for x in differentiation.fst_sites(c).collect()}
    assert (r[1].num, r[1].den, r[1].fst) == pytest.approx((0.5, 0.5, 1.0))
    assert (r[2].num, r[2].den, r[2].fst) == pytest.approx((0.0, 0.25, 0.0))


def test_king_duplicate_and_relabel(spark):
    rows = [(i, s, (i * 7 + 3) % 3) for i in range(50) for s in (0, 1)]
    g = spark.createDataFrame(rows, "snp_idx long, sample_idx long, dosage int")
    k = relatedness.kinship(relatedness.king_counts(g)).first()
    assert k.phi == 0.5 and k.degree == "duplicate"
    flipped = relatedness.king_counts(g.withColumn("dosage", 2 - F.col("dosage"))).first()
    assert (flipped.hethet, flipped.ibs0, flipped.nsnp) == (k.hethet, k.ibs0, k.nsnp)


def test_king_by_tiles_equals_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(s), int(rng.integers(0, 3))) for i in range(40) for s in range(9) if rng.random() > 0.2]
    g = spark.createDataFrame(rows, "snp_idx long, sample_idx long, dosage int")
    every = g.select('sample_idx').distinct()
    pairs = every.withColumnRenamed('sample_idx', 'id2').join(every.withColumnRenamed('sample_idx', 'id1'), F.lit(True))
    whole = sorted(relatedness.king_counts(g).collect())
    assert whole == sorted(relatedness.king_counts(g, pairs).collect())
    monkeypatch.setattr(relatedness, 'TILE', 4)
    monkeypatch.setattr(relatedness, 'GROUP', 50)
    assert whole == sorted(relatedness.king_counts(g).collect())


def test_king_cutoff(spark):
    kin = spark.createDataFrame([(1, 2, 0.3), (2, 3, 0.3), (4, 5, 0.3), (6, 7, 0.01)], "id1 long, id2 long, phi double")
    samples = spark.createDataFrame([(i,) for i in range(1, 8)], "sample_idx long")
    gone = {r.sample_idx for r in relatedness.king_cutoff(kin, samples, 0.1).collect() if r.removed}
    assert gone == {2, 5}


def test_windows(spark):
    snps = spark.createDataFrame([(1, 1, p) for p in (5, 17, 40, 88)] + [(9, 2, 7)], "snp_idx long, chrom int, pos_bp long")
    w = sorted((r.start, r.end) for r in differentiation.windows(snps, 20, 10).collect())
    assert w[0] == (5, 24) and w[1] == (15, 34) and w[-1][1] == 88 and all(b <= 88 for _, b in w) and len(w) == 8
    assert {r.chrom for r in differentiation.windows(snps, 20, 10).collect()} == {1}


def test_block_walk_is_anchored(spark):
    snps = spark.createDataFrame([(i, 1, p) for i, p in enumerate((0.0, 4.0, 6.0, 9.0, 11.0, 30.0))] + [(9, 2, 1.0)], "snp_idx long, chrom int, genpos_m double")
    b = {r.snp_idx: r.block_id for r in blocks.assign_blocks(snps, 5).collect()}
    assert b == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 9: 4}


def test_filters_are_inclusive(spark):
    snps = spark.createDataFrame([(1, "a", 1, "A", "C"), (2, "b", 1, "A", "T"), (3, "c", 23, "A", "G"), (4, "d", 1, "A", "N")], "snp_idx long, snp_id string, chrom int, ref string, alt string")
    assert frequencies.filter_snps(snps).count() == 4
    assert {r.snp_id for r in frequencies.filter_snps(snps, drop_ambiguous=True).collect()} == {"a", "c"}
    assert {r.snp_id for r in frequencies.filter_snps(snps, autosomes_only=True).collect()} == {"a", "b"}
    assert {r.snp_id for r in frequencies.filter_snps(snps, transversions_only=True).collect()} == {"a", "b"}
    g = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 0)], "snp_idx long, sample_idx long, dosage int")
    assert {r.snp_id for r in frequencies.filter_snps(snps, g, 2, maf=0.25).collect()} == {"a"}


def tensor_of(spark, pops=6, nb=30, seed=2):
    rng = np.random.default_rng(seed)
    drift = rng.random((nb, pops, pops)) * 0.02
    rows = []
    for b in range(nb):
        for i in range(pops):
            for j in range(i, pops):
                rows.append((b, f"P{i}", f"P{j}", 0.0 if i == j else float(0.05 + abs(i - j) * 0.01 + drift[b, i, j]), 10, 10 + b % 3))
    return spark.createDataFrame(rows, "block_id int, p1 string, p2 string, f2 double, vpair long, block_size long")


def test_sweep_equals_explicit(spark):
    t = tensor_of(spark)
    q = [c for c in itertools.combinations([f"P{i}" for i in range(6)], 4)]
    items = spark.createDataFrame(q, "pop1 string, pop2 string, pop3 string, pop4 string")
    a = {(r.pop1, r.pop2, r.pop3, r.pop4): (r.est, r.se) for r in fstats.f4(t, items).collect()}
    b = {(r.pop1, r.pop2, r.pop3, r.pop4): (r.est, r.se) for r in fstats.sweep(t, 4, min_z=0).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
    with pytest.raises(ValueError):
        fstats.sweep(t, 4, most=3)


def test_survivors_drop_partly_seen_blocks(spark):
    t = tensor_of(spark).filter("NOT (block_id = 3 AND p1 = 'P0' AND p2 = 'P1')")
    assert 3 not in {r.block_id for r in fstats.survivors(t).select("block_id").distinct().collect()}


def test_qpadm_recovers_a_mixture():
    rng = np.random.default_rng(5)
    nb, m = 60, 200
    f = rng.random((nb, m, 6))
    f[:, :, 0] = 0.3 * f[:, :, 1] + 0.7 * f[:, :, 2]  # target 0 of sources 1 and 2; 3, 4, 5 share drift with the sources
    f[:, :, 3] = 0.5 * f[:, :, 1] + 0.5 * f[:, :, 3]
    f[:, :, 4] = 0.5 * f[:, :, 2] + 0.5 * f[:, :, 4]
    d = f[:, :, :, None] - f[:, :, None, :]
    f2 = (d * d).mean(axis=1)
    r = models.fit(f2, np.full(nb, float(m)), 0, [1, 2], [5, 3, 4])
    assert r["status"] == "ok" and r["weights"] == pytest.approx([0.3, 0.7], abs=0.02)
    assert [x["f4rank"] for x in r["rankdrop"]] == [1, 0] and r["rankdrop"][-1]["dofdiff"] is None
    assert {x["pat"] for x in r["popdrop"]} == {"00", "01", "10"}


def test_stacked_factors_equal_single_ones():
    rng = np.random.default_rng(8)
    x, q = rng.random((5, 3, 4)), np.linalg.inv(np.eye(12) + 0.1)
    for r in (0, 1, 2):
        one = [models.low_rank(m, q, r)[0] for m in x]
        assert np.allclose(models.left_factors(x, q, r), np.array(one).reshape(5, 3, r), rtol=1e-8)


def test_unknown_label_is_a_status(spark):
    t = tensor_of(spark)
    m = spark.createDataFrame([(0, "P0", ["nobody"], ["P1", "P2"])], "model_id long, target string, left array<string>, right array<string>")
    assert models.qpadm(m, t).first().status == "invalid_config"
    assert models.qpwave(t, ["P0", "P1"], ["P2", "P3", "P4"]).count() == 1


def test_graph_fit_recovers_a_tree():
    length = {"a": 0.1, "b": 0.2, "c": 0.05, "d": 0.3, "ab": 0.07}
    dist = lambda x, y: sum(length[k] for k in {x, y}) + (length["ab"] if (x in "ab") != (y in "ab") else 0)
    pops = list("abcd")
    rng = np.random.default_rng(0)
    f2 = np.array([[[0 if x == y else dist(x, y) for y in pops] for x in pops]] * 20) + rng.normal(0, 1e-4, (20, 4, 4))
    f2 = (f2 + f2.transpose(0, 2, 1)) / 2
    edges = [("R", "ab"), ("R", "cd"), ("ab", "a"), ("ab", "b"), ("cd", "c"), ("cd", "d")]
    r = graphs.fit(f2, np.ones(20), pops, edges)
    assert r["lengths"][2:] == pytest.approx([0.1, 0.2, 0.05, 0.3], abs=2e-3)
    with pytest.raises(ValueError):
        graphs.parse([("a", "b"), ("b", "a")])
    assert len(graphs.topologies(list("abcd"))) == 3 and len(graphs.topologies(list("abcde"))) == 15


def test_search_takes_graphs_of_one_mixture(monkeypatch):
    from kinfold.plans import fits

    asked = []
    monkeypatch.setattr(fits, "nation_tensor", lambda *a: None)
    monkeypatch.setattr(graphs, "search", lambda spark, tensor, leaves, mixtures=0, **k: asked.append(mixtures))
    fits.q_search(None, "")
    mixed = [len(graphs.parse(t).mixed) for t in graphs.topologies(list("abcde"), asked[0])]
    assert mixed.count(0) == 15 and mixed.count(1) > 15


def test_nonnegative_least_squares():
    a = np.array([[1.0, 1.0], [1.0, 2.0], [1.0, 3.0]])
    assert graphs.nonnegative(a, a @ np.array([0.5, 2.0])) == pytest.approx([0.5, 2.0], rel=1e-6)
    assert graphs.nonnegative(a, np.array([3.0, 2.0, 1.0]))[1] == 0


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (60, 8))
    df = spark.createDataFrame([(int(i), int(j), int(g[i, j])) for i in range(60) for j in range(8)], "snp_idx long, sample_idx long, dosage int")
    out = {r.sample_idx: r for r in structure.pca(df, spark.createDataFrame([(i,) for i in range(8)], "sample_idx long"), 3).collect()}
    p = g.mean(axis=1) / 2
    ok = (p > 0) & (p < 1)
    z = (g[ok] - 2 * p[ok, None]) / np.sqrt(p[ok] * (1 - p[ok]))[:, None]
    v = np.linalg.eigvalsh(z.T @ z)[::-1]
    assert [out[-1].pc1, out[-1].pc2] == pytest.approx(v[:2], rel=1e-9)
    assert sum(out[i].pc1 ** 2 for i in range(8)) == pytest.approx(v[0], rel=1e-9)


def test_admixture_likelihood_rises(spark):
    rng = np.random.default_rng(3)
    f = np.where(np.arange(80)[:, None] % 2 == 0, [0.9, 0.1], [0.2, 0.8])
    rows = [(int(i), int(j), int(rng.binomial(2, f[i, j // 6]))) for i in range(80) for j in range(12)]
    df = spark.createDataFrame(rows, "snp_idx long, sample_idx long, dosage int")
    q, trace = structure.admixture(df, spark.createDataFrame([(i,) for i in range(12)], "sample_idx long"), 2, rounds=25)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    q = {r.sample_idx: r.q for r in q.collect()}
    assert np.argmax(q[0]) != np.argmax(q[11]) and max(q[0]) > 0.8


def test_ancestry_fits_say_whether_they_converged(spark, monkeypatch):
    from kinfold.plans import fits

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(i), int(j), int(rng.binomial(2, 0.9 if i % 2 == j // 3 else 0.2))) for i in range(20) for j in range(6)], "snp_idx long, sample_idx long, dosage int")
    who = spark.createDataFrame([(i,) for i in range(6)], "sample_idx long")
    short = structure.admixture(df, who, 2, rounds=2)[0].first()
    assert (short.rounds, short.converged) == (2, False)
    whole, trace = structure.admixture(df, who, 2, tol=1e-2)
    whole = whole.first()
    assert whole.converged and whole.rounds == len(trace) < 200
    gl = df.groupBy("snp_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "dosage"))).alias("c")).select(F.col("snp_idx").alias("site"), F.flatten(F.transform("c", lambda x: F.array(*[F.when(x.dosage == k, 0.9).otherwise(0.05) for k in range(3)]))).alias("l"))
    one = structure.pcangsd(gl, 6, rounds=1).first()
    assert (one.rounds, one.converged) == (1, False)
    asked = {}
    monkeypatch.setattr(structure, "admixture", lambda *a, rounds=200, **k: asked.update(admixture=rounds) or [None])
    monkeypatch.setattr(structure, "pcangsd", lambda *a, rounds=100, **k: asked.update(pcangsd=rounds))
    fits.q_admixture(spark, "/root/testdata/sf0.001")
    fits.q_pcangsd(spark, "/root/testdata/sf0.001")
    assert asked == {"admixture": 200, "pcangsd": 100}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, rho, pi = rng.random((4, 3)), np.array([1, 0.2, 0.3, 0.1]), np.full(3, 1 / 3)
    total = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = pi[path[0]] * e[0, path[0]]
        for i in range(1, 4):
            w *= ((1 - rho[i]) * (path[i] == path[i - 1]) + rho[i] * pi[path[i]]) * e[i, path[i]]
        for i, s in enumerate(path):
            total[i, s] += w
    assert haplotypes.forward_backward(e, rho, pi)[0] == pytest.approx(total / total.sum(axis=1, keepdims=True))


def test_segments():
    m = np.arange(100) / 500
    post = np.zeros(100)
    post[10:55] = post[57:99] = 1
    assert haplotypes.ibd_segments(post, m, least_cm=8, gap_cm=0.75) == [(10, 98)]
    assert haplotypes.ibd_segments(post, m, least_cm=8.5, gap_cm=0.75) == [(10, 54)]
    assert haplotypes.roh_segments(post, m, gap_m=0.0) == [(10, 54), (57, 98)]


def test_posteriors_of_many_pairs_equal_single_ones():
    rng = np.random.default_rng(4)
    l1, l2, freq, m = rng.random((30, 2, 7)), rng.random((30, 2, 7)), rng.uniform(0.05, 0.95, 30), np.sort(rng.random(30))
    got = haplotypes.ibd_posteriors(l1, l2, freq, m)
    for k in range(7):
        assert got[:, k] == pytest.approx(haplotypes.ibd_posterior(l1[:, :, k], l2[:, :, k], freq, m), rel=1e-9)


def test_ibd_of_all_pairs_equals_single_scans(spark):
    rng = np.random.default_rng(6)
    alleles = rng.integers(-1, 2, (6, 40)).astype(np.int8)
    alleles[3] = alleles[1]
    p = haplotypes.Panel(np.arange(40), np.arange(40) / 200, alleles, list("aabbcc"), list(range(10, 16)))
    like = lambda a: np.repeat(np.where(a < 0, 0.5, np.clip(a, 0.02, 0.98))[:, :, None], 2, axis=2)
    pairs = list(itertools.combinations(p.ids, 2))
    seen = alleles >= 0
    freq = np.clip((alleles * seen).sum(axis=0) / np.maximum(seen.sum(axis=0), 1), 0.01, 0.99)
    want = set()
    for a, b in pairs:
        post = haplotypes.ibd_posterior(like(alleles)[a - 10], like(alleles)[b - 10], freq, p.morgans)
        want |= {(a, b, s, e) for s, e in haplotypes.ibd_segments(post, p.morgans, 0.6, 0.5)}
    for arg in (pairs, spark.createDataFrame(pairs, "id1 long, id2 long")):
        got = {(r.id1, r.id2, r.first_snp, r.last_snp) for r in haplotypes.ibd(spark, {1: p}, like, arg, cutoff=0.6, least_cm=0.5).collect()}
        assert got == want and (11, 13) in {x[:2] for x in got}


def test_scans_take_every_sample(spark, monkeypatch):
    from kinfold.plans import fits, fixture

    sf = "/root/testdata/sf0.001"
    ids = {r.sample_idx for r in fixture.samples(spark, sf).collect()}
    assert len(ids) == 10
    assert {r.recipient for r in fits.q_paint(spark, sf).select("recipient").collect()} == ids
    assert {r.recipient for r in fits.q_localanc(spark, sf).select("recipient").distinct().collect()} == ids
    assert {r.sample_idx for r in fits.q_roh(spark, sf).collect()} == ids
    asked = []
    monkeypatch.setattr(haplotypes, "ibd_summary", lambda s: s)
    monkeypatch.setattr(haplotypes, "ibd", lambda spark, p, like, pairs, **k: asked.append(pairs) or pairs)
    fits.q_ibd(spark, sf)
    assert {(r.id1, r.id2) for r in asked[0].collect()} == set(itertools.combinations(sorted(ids), 2))


def test_exponential_fit():
    x = np.arange(5, 200) * 0.001
    assert dating.exponential_fit(x, 0.3 * np.exp(-40 * x) + 0.01, 0.001) == pytest.approx(40, rel=1e-4)


def test_dates_use_lags_up_to_one_morgan(monkeypatch):
    from unittest.mock import MagicMock

    from kinfold.plans import fits

    asked = {}
    monkeypatch.setattr(fits, "fx", MagicMock())
    monkeypatch.setattr(fits, "F", MagicMock())
    monkeypatch.setattr(dating, "date_moments", lambda *a, most, **k: asked.update(most=most) or MagicMock())
    monkeypatch.setattr(dating, "date", lambda *a, high, **k: asked.update(high=high))
    fits.q_dates(None, "")
    assert asked == {"most": 1.0, "high": 1.0}


def test_empty_tables(spark):
    g = spark.createDataFrame([], "snp_idx long, sample_idx long, pop string, dosage int")
    assert frequencies.pop_counts(g).count() == 0 and relatedness.king_counts(g).count() == 0
    assert differentiation.fst_sites(frequencies.pop_counts(g)).count() == 0
