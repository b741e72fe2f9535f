"""Extraction in one call, label resolution, site alignment, projections, reference bases and written reports."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import alignment, extract, relatedness, structure
from kinfold.plans import fixture as fx
from kinfold.sources import fasta, reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    return fx.genotypes(spark, SF).persist(), fx.snps(spark, SF).persist(), fx.samples(spark, SF).persist()


def test_extract_f2(panel):
    g, s, who = panel
    tensor, labels, counts = extract.extract_f2(g, s, who, ["ASIA", "AFRICA"], size=220_000, position="pos_bp")
    assert labels == ["ASIA", "AFRICA"] or labels == ["AFRICA", "ASIA"]
    assert 0 < counts["kept"] < counts["variants"] and counts["blocks"] > 1
    assert {(r.p1, r.p2) for r in tensor.collect()} <= {("AFRICA", "AFRICA"), ("AFRICA", "ASIA"), ("ASIA", "ASIA")}
    with pytest.raises(ValueError, match="unknown labels: NOWHERE"):
        extract.extract_f2(g, s, who, ["ASIA", "NOWHERE"])
    with pytest.raises(ValueError, match="repeated labels: ASIA"):
        extract.extract_f2(g, s, who, ["ASIA", "ASIA"])
    with pytest.raises(ValueError, match="no variant"):
        extract.filtered(g, s, who, extract.Filters(maf=0.51))
    with pytest.raises(ValueError, match="unknown labels: X"):
        extract.known_items(g.sparkSession.createDataFrame([("ASIA", "X")], "pop1 string, pop2 string"), tensor)


def test_filters_come_before_pruning(panel):
    g, s, who = panel
    rule = extract.Filters(drop_monomorphic=True, ld=(50, 5, 0.5))
    quality = extract.filtered(g, s, who, extract.Filters(drop_monomorphic=True))[1]
    both = extract.filtered(g, s, who, rule)[1]
    assert both.join(quality, "snp_idx", "left_anti").isEmpty() and both.count() <= quality.count()
    assert extract.individuals(who).select("pop").distinct().count() == who.count()


def test_polarised_sites(spark):
    site = "snp_idx long, chrom int, pos_bp long, ref string, alt string"
    a = spark.createDataFrame([(0, 1, 10, "A", "C"), (1, 1, 20, "C", "A"), (2, 1, 30, "T", "G"), (3, 1, 40, "A", "T"), (4, 1, 50, "A", "G"), (5, 1, 60, "A", "C"), (6, 1, 60, "A", "C"), (7, 2, 10, "G", "T")], site)
    b = spark.createDataFrame([(k + 100, c, p, "A", x) for k, (c, p, x) in enumerate([(1, 10, "C"), (1, 20, "C"), (1, 30, "C"), (1, 40, "T"), (1, 50, "C"), (1, 60, "C"), (2, 10, "C")])], site)
    got = {r.target_idx: (r.panel_idx, r.flip) for r in alignment.polarised(a, b).collect()}
    assert got == {0: (100, False), 1: (101, True), 2: (102, False), 3: (103, False), 7: (106, True)}
    calls = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (7, 1, None)], "snp_idx long, sample_idx long, dosage int")
    assert sorted((r.snp_idx, r.dosage) for r in alignment.flipped(calls, alignment.polarised(a, b)).collect()) == [(100, 2), (101, 0), (106, None)]
    alignment.same_markers(a, a)
    with pytest.raises(ValueError, match="markers differ"):
        alignment.same_markers(a, a.filter("snp_idx < 5"))


def test_complete_sites_and_frequencies(spark):
    g = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (1, 1, 0), (1, 2, None), (2, 1, 1), (2, 2, 0), (2, 3, 0)], "snp_idx long, sample_idx long, dosage int")
    who = spark.createDataFrame([(1,), (2,)], "sample_idx long")
    assert sorted(r[0] for r in alignment.complete_sites(g, who).collect()) == [0, 2]
    snps = spark.createDataFrame([("a", 0), ("b", 1)], "snp_id string, snp_idx long")
    freq = spark.createDataFrame([("b", 0.2), ("a", 0.1)], "snp_id string, f double")
    assert sorted((r.snp_idx, r.f) for r in alignment.matched_frequencies(freq, snps).collect()) == [(0, 0.1), (1, 0.2)]
    for bad in (freq.limit(1), freq.union(freq), freq.union(spark.createDataFrame([("c", 0.3)], "snp_id string, f double"))):
        with pytest.raises(ValueError, match="variants without"):
            alignment.matched_frequencies(bad, snps)


def dense(g, n):
    m = np.full((n, g.agg(F.max("snp_idx")).first()[0] + 1), np.nan)
    for r in g.collect():
        m[r.sample_idx, r.snp_idx] = r.dosage
    return m


def plain_z(m, ref):
    p = np.nanmean(m[ref], axis=0) / 2
    ok = (p > 0) & (p < 1)
    return (m[:, ok] - 2 * p[ok]) / np.sqrt(p[ok] * (1 - p[ok]))


def test_projection_is_least_squares(spark):
    rng = np.random.default_rng(3)
    f = rng.uniform(0.1, 0.9, (3, 400))
    rows = [(j, i, int(rng.binomial(2, f[i % 3, j]))) for i in range(24) for j in range(400) if i < 18 or rng.random() < (0.3 if i < 21 else 0.9)]
    g = spark.createDataFrame(rows, "snp_idx long, sample_idx long, dosage int")
    who = spark.range(24).select(F.col("id").alias("sample_idx"))
    ref = list(range(18))
    z = plain_z(dense(g, 24), ref)
    u, s, vt = np.linalg.svd(np.nan_to_num(z[ref]), full_matrices=False)
    for solver in ("exact", "randomized"):
        got = {r.sample_idx: np.array([r.pc1, r.pc2]) for r in structure.pca(g, who, 2, basis=ref, solver=solver).collect()}
        assert np.allclose(got[-1], s[:2] ** 2, rtol=1e-6)
        for i in range(24):
            seen = ~np.isnan(z[i])
            want = (u * s)[i, :2] if i < 18 else np.linalg.lstsq(vt[:2, seen].T, z[i, seen], rcond=None)[0]
            assert np.allclose(np.abs(got[i]), np.abs(want), atol=1e-4 * s[0])


def test_cutoff_by_family(spark):
    rng = np.random.default_rng(5)
    edges = {(min(a, b), max(a, b)) for f in range(6) for a, b in rng.integers(0, 7, (9, 2)) + 10 * f if a != b}
    kin = spark.createDataFrame([(int(a), int(b), 0.3) for a, b in edges], "id1 long, id2 long, phi double")
    who = spark.range(70).select(F.col("id").alias("sample_idx"))
    gone = {r.sample_idx for r in relatedness.king_cutoff(kin, who, 0.1).collect() if r.removed}
    near, want = {}, set()
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while near := {u: x for u, x in near.items() if x}:  # the rule on the whole graph at once
        single = min((u for u, x in near.items() if len(x) == 1), default=None)
        out = next(iter(near[single])) if single is not None else min(u for u, x in near.items() if len(x) == max(map(len, near.values())))
        want.add(out)
        near = {u: x - {out} for u, x in near.items() if u != out}
    assert gone == want


def test_reference_bases(spark, tmp_path):
    seqs = {"chr1": "acgtACGTNNacgtTTGACA", "2": "GGGCCCAAAT" * 9000}
    path, offset, index = tmp_path / "ref.fa", 0, []
    with open(path, "w") as f:
        for name, seq in seqs.items():
            offset += f.write(f">{name}\n")
            index.append(f"{name}\t{len(seq)}\t{offset}\t7\t8")
            offset += sum(f.write(seq[i : i + 7] + "\n") for i in range(0, len(seq), 7))
    (tmp_path / "ref.fa.fai").write_text("\n".join(index) + "\n")
    places = [("1", 1), ("chr1", 20), ("1", 8), ("1", 21), ("1", 0), ("2", 89_999), ("2", 7), ("3", 1), (None, 5), ("2", None)]
    df = spark.createDataFrame(places, "chrom string, pos long")
    got = {(r.chrom, r.pos): r.ref_base for r in fasta.reference_bases(df, str(path)).collect()}
    at = lambda c, p: seqs[c][p - 1].upper()
    assert got == {("1", 1): "A", ("chr1", 20): "A", ("1", 8): "T", ("1", 21): None, ("1", 0): None, ("2", 89_999): at("2", 89_999), ("2", 7): at("2", 7), ("3", 1): None, (None, 5): None, ("2", None): None}


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_reports(spark, panel, tmp_path):
    g, s, who = panel
    reports.write_kept_ids(s.limit(5), str(tmp_path / "ids"))
    assert lines(tmp_path / "ids") == [r.snp_id for r in s.limit(5).orderBy("snp_idx").collect()]
    kin = relatedness.kinship(relatedness.king_counts(g))
    reports.write_kin0(kin, who, str(tmp_path / "kin0"))
    rows = [x.split("\t") for x in lines(tmp_path / "kin0")]
    assert rows[0] == ["#IID1", "IID2", "NSNP", "HETHET", "IBS0", "KINSHIP"] and len([r for r in rows if r[0] != "#IID1"]) == kin.count()
    marked = relatedness.king_cutoff(kin, who, 0.1)
    reports.write_cutoff(marked, who, str(tmp_path / "x"))
    kept, out = (set(lines(tmp_path / f"x.king.cutoff.{k}.id")) - {"#IID"} for k in ("in", "out"))
    assert not kept & out and len(kept | out) == who.count()
    calls = spark.createDataFrame([("rs1", 1, 5, "called", 1), ("rs2", 1, 3, "absent", None)], "snp_id string, chrom int, pos long, state string, dosage int")
    counted = reports.write_ingest_report(calls, str(tmp_path / "report"))
    assert {r.state: r.sites for r in counted.collect()} == {"called": 1, "absent": 1} and "rs2\t1\t3\tabsent\t." in lines(tmp_path / "report")
    points = spark.createDataFrame([("a", "<x>", 0.1, 2.0), ("b", "y", 0.3, 1.0)], "sample_id string, pop string, pc1 double, pc2 double")
    page = reports.scatter_page(points)
    assert page.count("\\u003cx>") == 1 and not re.search(r"<x>", page)


def test_autosomes_and_tensor(panel):
    g, s, _ = panel
    calls, own = extract.autosomal_diploid(g, s)
    assert own.count() == s.filter("chrom BETWEEN 1 AND 22").count() and calls.count() == g.count()


def test_admixture_starts_and_projection(spark):
    rng = np.random.default_rng(8)
    f = rng.uniform(0.05, 0.95, (2, 150))
    q = rng.dirichlet([0.5, 0.5], 14)
    rows = [(j, i, int(rng.binomial(2, q[i] @ f[:, j]))) for i in range(14) for j in range(150) if rng.random() > 0.1]
    g = spark.createDataFrame(rows, "snp_idx long, sample_idx long, dosage int")
    who = spark.range(14).select(F.col("id").alias("sample_idx"))
    traces = [structure.admixture(g, who, 2, seed=s, rounds=12)[1] for s in (1, 2)]
    best, trace = structure.admixture(g, who, 2, seed=1, seeds=2, rounds=12)
    assert trace[-1] == pytest.approx(max(t[-1] for t in traces), rel=1e-9) and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    freq = spark.createDataFrame([(j, [float(x) for x in f[:, j]]) for j in range(0, 150, 2)], "snp_idx long, f array<double>")
    got = {r.sample_idx: np.array(r.q) for r in structure.admixture(g, who, 2, rounds=60, frequencies=freq)[0].collect()}
    own = dense(g, 14)[:, ::2]
    w = np.random.default_rng(1).dirichlet(np.ones(2), 14)
    for _ in range(60):  # the same rounds without Spark, frequencies held
        p = w @ f[:, ::2]
        seen, x = ~np.isnan(own), np.nan_to_num(own)
        t = w * (np.where(seen, x / p, 0) @ f[:, ::2].T + np.where(seen, (2 - x) / (1 - p), 0) @ (1 - f[:, ::2]).T)
        w = t / t.sum(axis=1, keepdims=True)
    assert all(np.allclose(got[i], w[i], atol=1e-2) for i in range(14))
