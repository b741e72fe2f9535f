"""f-statistics: block-wise f2, and f3, f4, f4-ratio and D with their block jackknife, as joins and aggregations.

Sums run in doubles; a block's terms come from integers, so results agree to rounding whatever the order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.special import two_sided_p, unrank
from kinfold.operators.blocks import block_sizes


def _per_snp(af: DataFrame) -> DataFrame:
    """snp_idx, pops: the populations of a variant in one sorted array (as many as there are populations)."""
    hc = F.col("q") * (1 - F.col("q")) / F.greatest(F.col("n") - 1, F.lit(1))
    return af.groupBy("snp_idx").agg(F.sort_array(F.collect_list(F.struct("pop", "q", hc.alias("hc")))).alias("pops"))


def pair_terms(af: DataFrame) -> DataFrame:
    """snp_idx, p1, p2 (p1 <= p2), f2: the unbiased squared difference of each pair at each variant, without a self-join."""
    one = _per_snp(af).select("snp_idx", "pops", F.explode("pops").alias("a"))
    two = one.select("snp_idx", "a", F.explode(F.filter("pops", lambda x: x["pop"] >= F.col("a.pop"))).alias("b"))
    d = F.col("a.q") - F.col("b.q")
    return two.select("snp_idx", F.col("a.pop").alias("p1"), F.col("b.pop").alias("p2"), (d * d - F.col("a.hc") - F.col("b.hc")).alias("f2"))


def f2_blocks(af: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, p1, p2, f2, vpair, block_size for p1 <= p2: means over the variants where both are seen; absent rows have none."""
    placed = pair_terms(af).join(blocks, "snp_idx")
    sums = placed.groupBy("block_id", "p1", "p2").agg((F.sum("f2") / F.count("*")).alias("f2"), F.count("*").alias("vpair"))
    return sums.join(block_sizes(blocks), "block_id")


def f2(af: DataFrame) -> DataFrame:
    """p1, p2, f2, vpair over all variants."""
    return pair_terms(af).groupBy("p1", "p2").agg((F.sum("f2") / F.count("*")).alias("f2"), F.count("*").alias("vpair"))


def survivors(tensor: DataFrame) -> DataFrame:
    """The tensor without blocks in which some pairs were seen and others were not."""
    pairs = tensor.select("p1", "p2").distinct().agg(F.count("*").alias("pairs"))
    whole = tensor.groupBy("block_id").agg(F.count("*").alias("seen")).join(F.broadcast(pairs), F.col("seen") == F.col("pairs")).select("block_id")
    return tensor.join(whole, "block_id", "left_semi")


def jackknife(rows: DataFrame, keys: list[str], x: str = "x", n: str = "block_size") -> DataFrame:
    """keys, est, se, z: the weighted delete-one-block jackknife of a block mean.  rows: one for each key and block.

    One shuffle by key: all moments are plain sums.  With r = n_b / N, the leave-one-out value is (tot - x r) / (1 - r),
    sum(loo (1 - r)) = sum(tot - x r), and so on; the variance needs est and line, so it takes a second pass over the key's
    blocks by a window on the same partitioning.
    """
    w = Window.partitionBy(*keys)
    s = rows.withColumn("_n", F.sum(n).over(w)).withColumn("_tot", F.sum(F.col(x) * F.col(n)).over(w) / F.col("_n")).withColumn("_r", F.col(n) / F.col("_n"))
    s = s.withColumn("_loo", (F.col("_tot") - F.col(x) * F.col("_r")) / F.nullif(1 - F.col("_r"), F.lit(0.0)))
    s = s.withColumn("_line", F.sum(F.col("_loo") * (1 - F.col("_r"))).over(w) / F.sum(1 - F.col("_r")).over(w))
    s = s.withColumn("_est", F.sum(F.col("_line") - F.col("_loo")).over(w) + F.sum(F.col("_loo") * F.col(n)).over(w) / F.col("_n"))
    h = F.col("_n") / F.col(n)
    tau = (F.col("_est") * h - F.col("_loo") * (h - 1) - F.col("_line")) / F.sqrt(h - 1)
    out = s.groupBy(*keys).agg(F.first("_est").alias("est"), (F.sum(tau * tau) / F.count("*")).alias("var"))
    se = F.when(F.col("var") > 0, F.sqrt("var"))
    return out.select(*keys, "est", se.alias("se"), (F.col("est") / se).alias("z"))


def with_p(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p", two_sided_p(F.col("z")))


def _looked_up(items: DataFrame, tensor: DataFrame, needs: dict[str, tuple[str, str]]) -> DataFrame:
    """items x blocks with a column of f2 for each needed pair of item columns; the items are a query's, a handful."""
    pairs = F.array(*(F.struct(F.lit(k).alias("term"), F.least(a, b).alias("p1"), F.greatest(a, b).alias("p2")) for k, (a, b) in needs.items()))
    wanted = items.withColumn("w", F.explode(pairs)).select(*items.columns, "w.term", F.col("w.p1").alias("p1"), F.col("w.p2").alias("p2"))
    met = wanted.join(tensor, ["p1", "p2"])
    values = [F.max(F.when(F.col("term") == k, F.when(F.col("p1") == F.col("p2"), 0.0).otherwise(F.col("f2")))).alias(k) for k in needs]
    return met.groupBy(*items.columns, "block_id").agg(F.first("block_size").alias("block_size"), *values)


def f4_blocks(tensor: DataFrame, quartets: DataFrame) -> DataFrame:
    """pop1..pop4, block_id, block_size, x."""
    t = _looked_up(quartets.select("pop1", "pop2", "pop3", "pop4"), survivors(tensor), {"f23": ("pop2", "pop3"), "f14": ("pop1", "pop4"), "f13": ("pop1", "pop3"), "f24": ("pop2", "pop4")})
    return t.withColumn("x", (F.col("f23") + F.col("f14") - F.col("f13") - F.col("f24")) / 2)


def f4(tensor: DataFrame, quartets: DataFrame) -> DataFrame:
    """pop1..pop4, est, se, z for each quartet."""
    return jackknife(f4_blocks(tensor, quartets), ["pop1", "pop2", "pop3", "pop4"])


def f3(tensor: DataFrame, triples: DataFrame) -> DataFrame:
    """pop1 (the target), pop2, pop3, est, se, z."""
    t = _looked_up(triples.select("pop1", "pop2", "pop3"), survivors(tensor), {"f12": ("pop1", "pop2"), "f13": ("pop1", "pop3"), "f23": ("pop2", "pop3")})
    return jackknife(t.withColumn("x", (F.col("f12") + F.col("f13") - F.col("f23")) / 2), ["pop1", "pop2", "pop3"])


def f4_ratio(tensor: DataFrame, tuples: DataFrame, least: float = 1e-6) -> DataFrame:
    """pop1..pop5, alpha, se, z: f4(1,2;3,4) / f4(1,2;5,4); blocks whose denominator is under `least` are left out."""
    keys = [f"pop{i}" for i in range(1, 6)]
    needs = {"f23": ("pop2", "pop3"), "f14": ("pop1", "pop4"), "f13": ("pop1", "pop3"), "f24": ("pop2", "pop4"), "f25": ("pop2", "pop5"), "f15": ("pop1", "pop5")}
    t = _looked_up(tuples.select(*keys), survivors(tensor), needs)
    w = Window.partitionBy(*keys)
    n = F.col("block_size")
    t = t.withColumn("num", F.expr("(f23 + f14 - f13 - f24) / 2")).withColumn("den", F.expr("(f25 + f14 - f15 - f24) / 2"))
    t = t.withColumn("all_n", F.sum(n).over(w)).withColumn("r", n / F.col("all_n"))
    for c in ("num", "den"):  # leave-one-out means over all blocks
        t = t.withColumn(f"{c}_loo", (F.sum(F.col(c) * n).over(w) / F.col("all_n") - F.col(c) * F.col("r")) / (1 - F.col("r")))
    t = t.filter(F.abs("den") >= least).withColumn("_n", F.sum(n).over(w)).withColumn("_tot", F.sum(F.col("num") * n).over(w) / F.sum(F.col("den") * n).over(w))
    t = t.withColumn("_r", F.col("num_loo") / F.col("den_loo"))
    t = t.withColumn("_est", F.sum(F.col("_tot") - F.col("_r")).over(w) + F.sum(F.col("_r") * n).over(w) / F.col("_n"))
    h = F.col("_n") / n
    tau = (h * F.col("_tot") - (h - 1) * F.col("_r") - F.col("_est")) / F.sqrt(h - 1)
    out = t.groupBy(*keys).agg(F.first("_est").alias("alpha"), (F.sum(tau * tau) / F.count("*")).alias("var"), F.count("*").alias("b")).filter("b > 1")
    se = F.when(F.col("var") > 0, F.sqrt("var"))
    return out.select(*keys, "alpha", se.alias("se"), (F.col("alpha") / se).alias("z"))


def dstat_blocks(af: DataFrame, blocks: DataFrame, quartets: DataFrame) -> DataFrame:
    """pop1..pop4, block_id, num, den, cnt: sums over variants where all four are seen."""
    keys = ["pop1", "pop2", "pop3", "pop4"]
    m = af.groupBy("snp_idx").agg(F.map_from_entries(F.collect_list(F.struct("pop", "q"))).alias("q")).join(blocks, "snp_idx")
    t = m.join(F.broadcast(quartets.select(*keys)), F.lit(True))  # a query's quartets, a handful
    a, b, c, d = (F.try_element_at("q", F.col(k)) for k in keys)
    t = t.select(*keys, "block_id", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).dropna()
    return t.groupBy(*keys, "block_id").agg(F.sum(F.expr("(a - b) * (c - d)")).alias("num"), F.sum(F.expr("(a + b - 2 * a * b) * (c + d - 2 * c * d)")).alias("den"), F.count("*").alias("cnt"))


def dstat(af: DataFrame, blocks: DataFrame, quartets: DataFrame) -> DataFrame:
    """pop1..pop4, est, se, z: D as a ratio of sums, each block weighted by its own number of variants."""
    keys = ["pop1", "pop2", "pop3", "pop4"]
    w = Window.partitionBy(*keys)
    n = F.col("cnt")
    t = dstat_blocks(af, blocks, quartets).withColumn("_n", F.sum(n).over(w)).withColumn("_w", 1 - n / F.col("_n"))
    # without a block: (sum - own) / (N - n), whose denominators cancel in the ratio
    t = t.withColumn("_r", (F.sum("num").over(w) - F.col("num")) / F.nullif(F.sum("den").over(w) - F.col("den"), F.lit(0.0)))
    t = t.withColumn("_tot", F.sum(F.col("_r") * F.col("_w")).over(w) / F.sum("_w").over(w))
    t = t.withColumn("_est", F.sum(F.col("_tot") - F.col("_r")).over(w) + F.sum(F.col("_r") * n).over(w) / F.col("_n"))
    h = F.col("_n") / n
    tau = h * F.col("_tot") - (h - 1) * F.col("_r") - F.col("_est")
    out = t.groupBy(*keys).agg(F.first("_est").alias("est"), (F.sum(tau * tau / (h - 1)) / F.count("*")).alias("var"), F.count("*").alias("b")).filter("b > 1")
    se = F.when(F.col("var") > 0, F.sqrt("var"))
    return out.select(*keys, "est", se.alias("se"), (F.col("est") / se).alias("z"))


# ---- all subsets --------------------------------------------------------------------------------------------------------
def dense(tensor: DataFrame, most_pops: int = 2000, only: set[str] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Populations, f2 as blocks x pops x pops, block sizes: for fits, after the survivor rule, which looks at all populations; `only` these are kept.  ValueError above `most_pops`.

    A row for each block reaches the driver, with one number for each pair of the populations kept.
    """
    t = survivors(tensor)
    if only is not None:
        t = t.filter(F.col("p1").isin(*only) & F.col("p2").isin(*only)) if only else t.limit(0)
    pairs = sorted(map(tuple, t.select("p1", "p2").distinct().collect()))  # of populations
    pops = sorted({p for pair in pairs for p in pair})
    if len(pops) > most_pops:
        raise ValueError(f"{len(pops)} populations: more than a worker holds densely")
    at = {p: i for i, p in enumerate(pops)}
    # every surviving block has every pair
    rows = t.groupBy("block_id").agg(F.first("block_size").alias("n"), F.sort_array(F.collect_list(F.struct("p1", "p2", "f2"))).getField("f2").alias("f2"))
    packed = rows.toArrow().sort_by("block_id")
    out = np.zeros((len(packed), len(pops), len(pops)))
    if len(packed):
        i, j = np.array([at[p] for p, _ in pairs]), np.array([at[p] for _, p in pairs])
        v = np.where(i == j, 0.0, packed.column("f2").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(packed), len(pairs)))
        out[:, i, j] = out[:, j, i] = v
    return pops, out, packed.column("n").to_numpy().astype(float)


def jackknife_rows(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """est and se of each column of x (blocks x items)."""
    total = n.sum()
    r = (n / total)[:, None]
    tot = (x * n[:, None]).sum(0) / total
    loo = (tot - x * r) / (1 - r)
    line = (loo * (1 - r)).sum(0) / (1 - r).sum()
    est = (line - loo).sum(0) + (loo * n[:, None]).sum(0) / total
    h = 1 / r
    var = (((est * h - loo * (h - 1) - line) / np.sqrt(h - 1)) ** 2).mean(0)
    return est, np.where(var > 0, np.sqrt(var), np.nan)


def sweep(tensor: DataFrame, k: int, *, min_z: float | None = 3.0, top: int | None = None, most: int = 100_000_000, sure: bool = False, chunk: int = 4096) -> DataFrame:
    """Every k-subset of the populations (k = 4: f4(a,b;c,d); k = 3: f3(a;b,c), in label order), those with |z| >= min_z or the `top` by |z|; adds p.

    Ranks of subsets are ranges that Spark spreads; each task unranks its own and reads the broadcast tensor, whose size
    `dense` bounds.  ValueError above `most` subsets without `sure`.
    """
    spark = tensor.sparkSession
    pops, f2s, n = dense(tensor)
    total = math.comb(len(pops), k)
    if total > most and not sure:
        raise ValueError(f"{total} subsets: pass sure=True")
    shared = spark.sparkContext.broadcast((pops, f2s, n))
    names = [f"pop{i + 1}" for i in range(k)]

    def run(batches):
        labels, t, size = shared.value
        for b in batches:
            ranks = b.column("id").to_numpy()
            for at in range(0, len(ranks), chunk):
                c = unrank(ranks[at : at + chunk], len(labels), k).T
                x = (t[:, c[1], c[2]] + t[:, c[0], c[3]] - t[:, c[0], c[2]] - t[:, c[1], c[3]]) / 2 if k == 4 else (t[:, c[0], c[1]] + t[:, c[0], c[2]] - t[:, c[1], c[2]]) / 2
                est, se = jackknife_rows(x, size)
                z = est / se
                ok = np.isfinite(z) & (np.abs(z) >= (min_z if top is None and min_z is not None else 0))
                own = np.array(labels, object)[c][:, ok] if len(labels) else c[:, ok]
                yield pa.RecordBatch.from_arrays([*(pa.array(own[i].tolist(), pa.string()) for i in range(k)), pa.array(est[ok]), pa.array(se[ok]), pa.array(z[ok])], names=[*names, "est", "se", "z"])

    rows = spark.range(0, total, 1, max(1, min(total // chunk, 10_000))).mapInArrow(run, ", ".join([*(f"{x} string" for x in names), "est double, se double, z double"]))
    if top is not None:
        rows = rows.orderBy(F.desc(F.abs("z")), *names).limit(top)
    return with_p(rows)
