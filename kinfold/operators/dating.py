"""Admixture dates from the decay of ancestry covariance, and smoothed f2 tensors from all f-statistics."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Sums of x[i] x[i + d] for d < lags, by FFT."""
    n = 1 << (len(x) + lags).bit_length()
    f = np.fft.rfft(x, n)
    return np.fft.irfft(f * np.conj(f), n)[:lags]


def date_moments(geno: DataFrame, snps: DataFrame, target: str, source1: str, source2: str, *, step: float = 0.001, fine: int = 10, most: float = 1.0) -> DataFrame:
    """chrom, lag, s0, s11: pairs of binned variants at each genetic distance and the sum of their weighted residual products, over the target's samples.

    A sample's genotypes (halved) are regressed on both sources' frequencies; residuals are weighted by the sources'
    difference and binned, and each sample x chromosome takes one FFT.
    """
    from kinfold.operators.frequencies import allele_frequency

    af = allele_frequency(geno.filter(F.col("pop").isin(source1, source2)))
    of = lambda p: F.max(F.when(F.col("pop") == p, F.col("q")))
    w = af.groupBy("snp_idx").agg(of(source1).alias("w1"), of(source2).alias("w2")).dropna()
    rows = geno.filter((F.col("pop") == target) & F.col("dosage").isNotNull()).select("snp_idx", "sample_idx", (F.col("dosage") / 2).alias("g")).join(w, "snp_idx").join(snps.select("snp_idx", "chrom", "genpos_m"), "snp_idx")
    s = rows.groupBy("sample_idx").agg(*(F.sum(e).alias(k) for k, e in (("aa", F.expr("w1*w1")), ("ab", F.expr("w1*w2")), ("bb", F.expr("w2*w2")), ("ga", F.expr("g*w1")), ("gb", F.expr("g*w2")))))
    det = F.expr("aa*bb - ab*ab")
    coef = s.select("sample_idx", (F.expr("ga*bb - gb*ab") / F.nullif(det, F.lit(0.0))).alias("c1"), (F.expr("gb*aa - ga*ab") / F.nullif(det, F.lit(0.0))).alias("c2"))
    resid = rows.join(coef, "sample_idx").select("sample_idx", "chrom", "genpos_m", F.expr("(g - coalesce(c1, 0) * w1 - coalesce(c2, 0) * w2) * (w1 - w2)").alias("r"))
    cell = step / fine
    lags = int(round(most / step))

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if len(held) < GATHER:
                continue
            sample, chrom = (held.column(c).to_numpy() for c in ("sample_idx", "chrom"))
            other = np.flatnonzero((sample != sample[-1]) | (chrom != chrom[-1]))
            if len(other):  # the last sample x chromosome may go on
                cut = int(other[-1]) + 1
                lagged_products(held.slice(0, cut), cell, fine, lags, sums)
                held = held.slice(cut)
        if held is not None and len(held):
            lagged_products(held, cell, fine, lags, sums)
        for c, (s0, s11) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(lags, c, np.int32)), pa.array(np.arange(lags)), pa.array(s0), pa.array(s11)], names=["chrom", "lag", "s0", "s11"])

    # A task sends its sums of each chromosome and lag, whatever the number of its samples.  The key isn't the join's own, or
    # the exchange would be left to the join, which may turn into a broadcast and split samples.
    parts = resid.repartition(F.xxhash64("sample_idx")).sortWithinPartitions("sample_idx", "chrom", "genpos_m").mapInArrow(run, "chrom int, lag long, s0 double, s11 double")
    return parts.groupBy("chrom", "lag").agg(F.sum("s0").alias("s0"), F.sum("s11").alias("s11"))


#: Rows that a task of `date_moments` gathers before it multiplies, at least.
GATHER = 50_000
#: Pairs of variants that are multiplied at a time.
PAIRS = 2_000_000


def lagged_products(t: pa.Table, cell: float, fine: int, lags: int, sums: dict[int, np.ndarray]) -> None:
    """Adds pairs of cells, and of their sums of r, by lag to `sums` (chrom -> 2 x lags).  t: sample_idx, chrom, genpos_m, r in order, whole samples x chromosomes.

    Where a sample has few variants within reach of each other, pairs are taken one by one, else by FFT over the cells.
    """
    sample, chrom, x, r = (t.column(c).to_numpy() for c in ("sample_idx", "chrom", "genpos_m", "r"))
    head = np.flatnonzero((np.diff(sample, prepend=sample[0] - 1) != 0) | (np.diff(chrom, prepend=chrom[0]) != 0))
    tail = np.append(head[1:], len(x))
    group = np.repeat(np.arange(len(head)), tail - head)
    at = ((x - x[head][group]) / cell).astype(np.int64)
    wide = int(at.max()) + fine * lags + 1
    place = group * wide + at
    last = np.minimum(np.searchsorted(place, place + fine * lags), tail[group])
    many = last - np.arange(len(x))
    pairs, size = np.add.reduceat(many, head), at[tail - 1] + 1
    dense = pairs > 8 * (size + fine * lags)
    for c in np.unique(chrom):
        sums.setdefault(int(c), np.zeros((2, lags)))
    for g in np.flatnonzero(dense):
        own = slice(head[g], tail[g])
        y, n = np.bincount(at[own], r[own], size[g]), np.bincount(at[own], minlength=size[g]).astype(float)
        lag = np.arange(lags * fine) // fine
        sums[int(chrom[head[g]])] += [np.bincount(lag, autocorrelation(v, lags * fine), lags) for v in (n, y)]
    left = np.flatnonzero(~dense[group])
    to = np.cumsum(many[left])
    for part in np.split(left, np.flatnonzero(np.diff(to // PAIRS)) + 1):
        n = many[part]
        i = np.repeat(part, n)
        j = i + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        d = at[j] - at[i]
        times = np.where((d == 0) & (i != j), 2.0, 1.0)  # two variants of one cell meet both ways
        kinds, own = np.unique(chrom[part], return_inverse=True)
        key = np.repeat(own, n) * lags + d // fine
        found = [np.bincount(key, v, len(kinds) * lags).reshape(-1, lags) for v in (times, times * r[i] * r[j])]
        for k, c in enumerate(kinds):
            sums[int(c)] += [v[k] for v in found]


def exponential_fit(x: np.ndarray, y: np.ndarray, step: float) -> float:
    """Rate of a exp(-rate x) + c that fits y: a grid over the decay per step, refined by ternary search."""

    def loss(v: float) -> float:
        b = np.stack((v ** (x / step), np.ones(len(x))), axis=1)
        r = y - b @ np.linalg.lstsq(b, y, rcond=None)[0]
        return float(r @ r)

    grid = np.linspace(1e-4, 1 - 1e-4, 1000)
    k = int(np.argmin([loss(v) for v in grid]))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    for _ in range(100):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return -math.log((lo + hi) / 2) / step


def date(moments: DataFrame, weights: DataFrame, *, step: float = 0.001, low: float = 0.0045, high: float = 1.0) -> DataFrame:
    """date (generations), se: a fit to the covariance curve of all chromosomes, and its weighted jackknife over chromosomes (weights: chrom, n)."""
    t = moments.toPandas()  # chromosomes x lags
    n = weights.toPandas().set_index("chrom")["n"]
    s0, s11 = (t.pivot(index="chrom", columns="lag", values=c).fillna(0) for c in ("s0", "s11"))
    x = s0.columns.to_numpy() * step

    def one(chroms) -> float:
        a, b = s0.loc[chroms].sum().to_numpy(), s11.loc[chroms].sum().to_numpy()
        ok = (x >= low) & (x <= high) & (a >= 0.5)
        return exponential_fit(x[ok], b[ok] / a[ok], step) if ok.sum() > 3 else math.nan

    chroms = [c for c in s0.index if n.get(c, 0) > 0]
    total, whole = float(n.reindex(chroms).sum()), one(chroms)
    left = [(total / float(n[c]), one([d for d in chroms if d != c])) for c in chroms if float(n[c]) < total]
    left = [(h, v) for h, v in left if math.isfinite(v)]
    se = None
    if len(left) > 1 and math.isfinite(whole):
        est = len(left) * whole - sum((1 - 1 / h) * v for h, v in left)
        se = math.sqrt(sum((h * whole - (h - 1) * v - est) ** 2 / (h - 1) for h, v in left) / len(left))
    return moments.sparkSession.createDataFrame([(None if math.isnan(whole) else whole, se)], "date double, se double")


def smoothed_f2(af: DataFrame, blocks: DataFrame, pops: list[str], ridge: float = 1e-5) -> DataFrame:
    """block_id, p1, p2, f2, block_size: f2 of every pair from a least-squares fit to all f2, f3 and f4 of `pops` (four or more), block by block.

    Statistics are sums over variants where all their populations are seen (relational); each block is a small solve.
    """
    if len(pops) < 4:
        raise ValueError("four populations are needed")
    pops = sorted(pops)
    pairs = list(itertools.combinations(pops, 2))
    col = {p: i for i, p in enumerate(pairs)}
    stats: list[tuple[str, str, str, str]] = [(a, b, a, b) for a, b in pairs]
    stats += [(c, a, c, b) for c in pops for a, b in itertools.combinations([p for p in pops if p != c], 2)]
    stats += [q for a, b, c, d in itertools.combinations(pops, 4) for q in ((a, b, c, d), (a, c, b, d), (a, d, b, c))]
    design = np.zeros((len(stats), len(pairs)))
    for i, (a, b, c, d) in enumerate(stats):
        for s, x, y in ((1, b, c), (1, a, d), (-1, a, c), (-1, b, d)):
            if x != y:
                design[i, col[min(x, y), max(x, y)]] += s / 2
    m = af.filter(F.col("pop").isin(pops)).groupBy("snp_idx").agg(F.map_from_entries(F.collect_list(F.struct("pop", F.struct("q", (F.col("q") * (1 - F.col("q")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("h"))))).alias("m")).join(blocks, "snp_idx")
    rows = m.groupBy("block_id")

    def work(table: pa.Table) -> pa.Table:
        snps = table.column("m").to_pylist()
        q = np.full((len(snps), len(pops)), np.nan)
        h = np.full_like(q, np.nan)
        for i, s in enumerate(snps):
            for p, v in s:
                q[i, pops.index(p)], h[i, pops.index(p)] = v["q"], v["h"]
        at = {p: i for i, p in enumerate(pops)}
        y = np.full(len(stats), np.nan)
        for i, (a, b, c, d) in enumerate(stats):
            v = (q[:, at[a]] - q[:, at[b]]) * (q[:, at[c]] - q[:, at[d]])
            if a == c:
                v = v - h[:, at[a]]
            if b == d:
                v = v - h[:, at[b]]
            v = v[~np.isnan(v)]
            if len(v):
                y[i] = v.mean()
        ok = ~np.isnan(y)
        g = design[ok].T @ design[ok]
        x = np.linalg.solve(g + ridge * np.eye(len(g)), design[ok].T @ y[ok])
        return pa.table([pa.array([table.column("block_id")[0].as_py()] * len(pairs), pa.int32()), pa.array([p for p, _ in pairs]), pa.array([p for _, p in pairs]), pa.array(x), pa.array([len(snps)] * len(pairs), pa.int64())], names=["block_id", "p1", "p2", "f2", "block_size"])

    return rows.applyInArrow(work, "block_id int, p1 string, p2 string, f2 double, block_size long")
