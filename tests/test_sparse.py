"""Operators on tables in which few samples are called at a variant, and on more rows than one task should hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import meetings, relatedness

SF = "/root/testdata/sf0.001"


def calls(spark, seed=0, snps=300, samples=60, share=0.1):
    rng = np.random.default_rng(seed)
    rows = [(i, 5 * s, int(rng.integers(0, 3)), int(rng.integers(0, 2))) for i in range(snps) for s in range(samples) if rng.random() < share]
    return spark.createDataFrame(rows, "snp_idx long, sample_idx long, dosage int, hap int").withColumn("chrom", (F.col("snp_idx") % 3).cast("int")).withColumn("pos_bp", F.col("snp_idx") * 1000)


def traveled(monkeypatch):
    """Rows that reach a tile product or a tile of meetings, as they are dealt."""
    seen = []
    old = relatedness._tiles
    monkeypatch.setattr(relatedness, "_tiles", lambda *a, **k: seen.append("tiles") or old(*a, **k))
    return seen


@pytest.mark.parametrize("most", [50, 8_000_000])
def test_pairs_of_sparse_calls_equal_products(spark, monkeypatch, most):
    g = calls(spark)
    order = relatedness.snp_order(g.select("snp_idx", "chrom", "pos_bp").distinct()).select("snp_idx", "ord")
    hap = g.select("snp_idx", "sample_idx", "hap")
    all_of = lambda: [sorted(map(tuple, x.collect())) for x in (relatedness.king_counts(g), relatedness.mismatch_windows(hap, order, 20), relatedness.pair_rates(hap, order, 20))]
    monkeypatch.setattr(relatedness, "DENSE", 0)
    products = all_of()
    monkeypatch.setattr(relatedness, "DENSE", 2)
    monkeypatch.setattr(meetings, "MEETINGS", most)
    seen = traveled(monkeypatch)
    found = all_of()
    assert not seen and found[:2] == products[:2]
    assert [r[:4] for r in found[2]] == [r[:4] for r in products[2]]
    assert np.allclose([r[4:] for r in found[2]], [r[4:] for r in products[2]], rtol=1e-12)


def test_a_call_travels_to_its_own_tiles_only(spark):
    """Tiles that have no call at a variant get nothing of it, however many samples there are."""
    g = spark.createDataFrame([(i, 1000 * i + s, 1) for i in range(50) for s in range(4)], "snp_idx long, sample_idx long, dosage int")
    lists = meetings.variant_calls(g, "dosage")
    ids, met, share = meetings.census(lists)
    assert len(ids) == 200 and share == pytest.approx(4 / 200)
    starts = meetings.tiles(met, 32)
    assert len(starts) == 25
    assert meetings.deal(lists, ids, starts, [], later=True).count() == 50


def test_cutoff_of_one_large_family(spark):
    """The removals of a family are those of the plain rule: the partner of the first with one relative, else the first with the most."""
    rng = np.random.default_rng(3)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (150, 2)) if a != b})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone = set()
    while near:
        single = [u for u in near if len(near[u]) == 1]
        out = next(iter(near[min(single)])) if single else min(near, key=lambda u: (-len(near[u]), u))
        gone.add(out)
        for v in near.pop(out):
            near[v].discard(out)
            if not near[v]:
                del near[v]
    kin = spark.createDataFrame([(a, b, 0.3) for a, b in pairs], "id1 long, id2 long, phi double")
    got = relatedness.king_cutoff(kin, spark.range(60).withColumnRenamed("id", "sample_idx"), 0.1)
    assert {r.sample_idx for r in got.collect() if r.removed} == gone


def test_map_points_are_sought_in_growing_frames(spark):
    """No frame of the as-of join reaches to the partition's end: Spark reads such a frame again for every row."""
    from kinfold.sources import ingest

    s = spark.createDataFrame([(1, p) for p in (5, 10, 15, 20, 25, 40, 99)], "chrom int, pos long")
    g = spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0), (1, 20, 2.0), (1, 40, 6.0)], "chrom int, pos long, cm double")
    out = ingest.interpolate_map(s, g)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert {r.pos: round(100 * r.morgans, 9) for r in out.collect()} == {5: 1.0, 10: 1.0, 15: 2.0, 20: 2.0, 25: 3.0, 40: 6.0, 99: 6.0}


def test_date_moments_take_pairs_where_calls_are_sparse(spark, monkeypatch):
    """Sums of few variants on a long chromosome equal those of the FFT over all cells, which isn't taken."""
    import pyarrow as pa

    from kinfold.operators import dating

    rng = np.random.default_rng(5)
    rows = sorted((s, c, float(x), float(rng.normal())) for s in range(6) for c in (1, 2) for x in [0.5, 0.50001, *(rng.integers(0, 20_000, 25) * 1e-3)])
    t = pa.table(dict(zip(("sample_idx", "chrom", "genpos_m", "r"), map(np.array, zip(*rows)))))
    want = {1: np.zeros((2, 1000)), 2: np.zeros((2, 1000))}
    for s in range(6):
        for c in (1, 2):
            x, r = np.array([v[2:] for v in rows if v[:2] == (s, c)]).T
            at = ((x - x[0]) / 1e-4).astype(int)
            lag = np.arange(10_000) // 10
            want[c] += [np.bincount(lag, dating.autocorrelation(v, 10_000), 1000) for v in (np.bincount(at).astype(float), np.bincount(at, r))]
    monkeypatch.setattr(dating, "autocorrelation", lambda *a: pytest.fail("an FFT for each sample"))
    sums = {}
    dating.lagged_products(t, 1e-4, 10, 1000, sums)
    assert all(np.allclose(sums[c], want[c], atol=1e-9) for c in want)


def test_variant_aggregates_share_one_exchange(spark):
    """Counts by variant, and a variant's pairs, are where the calls were dealt to."""
    from kinfold.operators import differentiation, frequencies
    from kinfold.plans import fixture

    plan = differentiation.fst_sites(frequencies.pop_counts(fixture.genotypes(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    g = fixture.genotypes(spark, SF)
    plan = frequencies.allele_frequency(g, frequencies.detect_ploidy(g))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_fits_collect_their_own_populations_only(spark, monkeypatch):
    """What reaches the driver is a row for each block, with the pairs of a model's populations; the survivor rule still looks at all."""
    from kinfold.operators import fstats, models

    rng = np.random.default_rng(2)
    pops = [f"P{i}" for i in range(9)]
    rows = [(b, p, q, float(rng.random()), 10, 5 + b % 3) for b in range(30) for i, p in enumerate(pops) for q in pops[i:] if not (b == 7 and q == "P8")]
    t = spark.createDataFrame(rows, "block_id int, p1 string, p2 string, f2 double, vpair long, block_size long")
    names, whole, n = fstats.dense(t)
    assert names == pops and whole.shape == (29, 9, 9) and n.tolist() == [5 + b % 3 for b in range(30) if b != 7]
    v = {r[:3]: r[3] for r in rows}
    assert whole[3, 1, 4] == whole[3, 4, 1] == v[3, "P1", "P4"] and whole[8, 2, 2] == 0 and whole[7, 0, 5] == v[8, "P0", "P5"]
    asked = []
    old = fstats.dense
    monkeypatch.setattr(models, "dense", lambda *a, **k: asked.append(old(*a, **k)) or asked[-1])
    m = spark.createDataFrame([(0, "P0", ["P2", "P3"], ["P4", "P5", "P6"])], "model_id long, target string, left array<string>, right array<string>")
    got = models.qpadm(m, t).first()
    assert asked[0][0] == ["P0", "P2", "P3", "P4", "P5", "P6"] and asked[0][1].shape == (29, 6, 6)
    want = models.fit(whole, n, 0, [2, 3], [4, 5, 6])
    assert np.allclose(got.weights, want["weights"]) and np.allclose(got.se, want["se"]) and got.p == pytest.approx(want["p"])


def test_components_are_computed_once(spark):
    """The plan of all pairs stays short: no step is written out again at each of its uses."""
    from kinfold.operators import differentiation, frequencies
    from kinfold.plans import fixture

    sites = differentiation.fst_sites(frequencies.pop_counts(fixture.genotypes(spark, SF))).filter("den IS NOT NULL")
    plan = sites._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(n1") < 2 and len(plan) < 10_000
