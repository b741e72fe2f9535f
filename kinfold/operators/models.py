"""Admixture models on the f2 tensor: rank tests, weights, rotation over source sets, and a gated search.

A model is a small dense fit; models are spread over tasks and the tensor, whose size `fstats.dense` bounds, is broadcast.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.special import chisq_upper
from kinfold.operators.fstats import dense

FUDGE = 1e-4
ROUNDS = 20
#: Matrices that are refitted together.
STACK = 4096


@dataclass
class Moments:
    """The f4 matrix of a model: total, leave-one-out values and inverse covariance (row-major over sources x outgroups)."""

    total: np.ndarray
    loo: np.ndarray
    inverse: np.ndarray
    covariance: np.ndarray


def moments(f2: np.ndarray, n: np.ndarray, left: list[int], right: list[int], fudge: float = FUDGE) -> Moments:
    """left[0] and right[0] are the references: entry (i, j) is f4(left0, left_i; right0, right_j)."""
    a, r = np.array(left[1:]), np.array(right[1:])
    x = (f2[:, a, right[0]][:, :, None] + f2[:, left[0], r][:, None, :] - f2[:, left[0], right[0]][:, None, None] - f2[:, a[:, None], r[None]]) / 2
    shape = x.shape[1:]
    x = x.reshape(len(n), -1)
    share = (n / n.sum())[:, None]
    tot = (x * share).sum(0)
    loo = (tot - x * share) / (1 - share)
    line = (loo * (1 - share)).sum(0) / (1 - share).sum()
    est = (line - loo).sum(0) + (loo * share).sum(0)
    h = 1 / share
    tau = (est * h - loo * (h - 1) - line) / np.sqrt(h - 1)
    q = tau.T @ tau / len(n)
    ridge = q + fudge * np.trace(q) * np.eye(len(q))
    return Moments(est.reshape(shape), loo.reshape(-1, *shape), np.linalg.inv(ridge), q)


def _ridge_solve(design: np.ndarray, inverse: np.ndarray, x: np.ndarray, fudge: float) -> np.ndarray:
    w = inverse @ design
    m = design.T @ w
    return np.linalg.solve(m + fudge * np.trace(m) * np.eye(len(m)), w.T @ x)


def low_rank(x: np.ndarray, inverse: np.ndarray, rank: int, fudge: float = FUDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """x ~ a @ b of a given rank under the metric `inverse`, by alternating least squares from the singular vectors; and its chi-square."""
    nl, nr = x.shape
    a, b = np.zeros((nl, 0)), np.zeros((0, nr))
    if rank:
        b = np.linalg.svd(x)[2][:rank]
        a = x @ b.T
        flat = x.reshape(-1)
        for _ in range(rounds):
            a = _ridge_solve(np.kron(np.eye(nl), b.T), inverse, flat, fudge).reshape(nl, rank)
            b = _ridge_solve(np.kron(a, np.eye(nr)), inverse, flat, fudge).reshape(rank, nr)
    e = (x - a @ b).reshape(-1)
    return a, b, float(e @ inverse @ e)


def weights_of(a: np.ndarray) -> np.ndarray:
    """Source weights from the left factor; also for a stack of factors."""
    m = np.concatenate([a, np.ones((*a.shape[:-1], 1))], axis=-1)
    w = np.linalg.solve(m @ np.swapaxes(m, -1, -2), np.ones((*a.shape[:-1], 1)))[..., 0]
    return w / w.sum(axis=-1, keepdims=True)


def left_factors(x: np.ndarray, inverse: np.ndarray, rank: int, fudge: float = FUDGE, rounds: int = ROUNDS) -> np.ndarray:
    """The left factors of `low_rank` for a stack of matrices (leave-one-out refits), solved together."""
    n, nl, nr = x.shape
    if not rank:
        return np.zeros((n, nl, 0))
    if n > STACK:
        return np.concatenate([left_factors(x[s : s + STACK], inverse, rank, fudge, rounds) for s in range(0, n, STACK)])
    flat = x.reshape(n, -1, 1)

    def solved(design: np.ndarray) -> np.ndarray:
        w = inverse @ design
        m = np.swapaxes(design, 1, 2) @ w
        ridge = fudge * np.trace(m, axis1=1, axis2=2)[:, None, None] * np.eye(m.shape[1])
        return np.linalg.solve(m + ridge, np.swapaxes(w, 1, 2) @ flat)[..., 0]

    b = np.linalg.svd(x)[2][:, :rank]
    a = np.zeros((n, nl, rank))
    for _ in range(rounds):
        a = solved((np.eye(nl)[None, :, None, :, None] * np.swapaxes(b, 1, 2)[:, None, :, None, :]).reshape(n, nl * nr, nl * rank)).reshape(n, nl, rank)
        b = solved((a[:, :, None, :, None] * np.eye(nr)[None, None, :, None, :]).reshape(n, nl * nr, rank * nr)).reshape(n, rank, nr)
    return a


def dof(nl: int, nr: int, rank: int) -> int:
    return (nl - rank) * (nr - rank)


def rank_table(m: Moments, alpha: float = 0.05) -> tuple[list[dict], int]:
    """A row for each rank, the highest first, with its nested comparison; and the first rank that is not rejected."""
    nl, nr = m.total.shape
    top = min(nl, nr) - 1
    chisq = [low_rank(m.total, m.inverse, r)[2] for r in range(top + 1)]
    d = [dof(nl, nr, r) for r in range(top + 1)]
    p = [chisq_upper(c, k) for c, k in zip(chisq, d)]
    rows = []
    for r in range(top, -1, -1):
        row = {"f4rank": r, "dof": d[r], "chisq": chisq[r], "p": p[r], "dofdiff": None, "chisqdiff": None, "p_nested": None}
        if r:
            diff = chisq[r - 1] - chisq[r]
            row |= {"dofdiff": d[r - 1] - d[r], "chisqdiff": diff, "p_nested": chisq_upper(diff, d[r - 1] - d[r])}
        rows.append(row)
    return rows, next((r for r in range(top + 1) if p[r] > alpha), top)


def fit(f2: np.ndarray, n: np.ndarray, target: int, left: list[int], right: list[int], alpha: float = 0.05, with_se: bool = True, full: bool = True) -> dict:
    """One model: weights with standard errors, fit, ranks, and every nested set of sources."""
    out: dict = {"status": "ok", "weights": None, "se": None, "z": None, "chisq": None, "dof": None, "p": None, "f4rank": None, "rankdrop": None, "popdrop": None}
    if len(left) < 1 or len(right) <= len(left) - 1 or len(right) < 2:
        return out | {"status": "invalid_config"}
    try:
        m = moments(f2, n, [target, *left], right)
        nl, nr = m.total.shape
        rank = nl - 1
        a, _, chisq = low_rank(m.total, m.inverse, rank)
        w = weights_of(a)
        out |= {"weights": w.tolist(), "chisq": chisq, "dof": dof(nl, nr, rank), "p": chisq_upper(chisq, dof(nl, nr, rank))}
        if out["dof"] <= 0:
            out["status"] = "chisq_undefined"
        if with_se:
            b = len(n)
            each = weights_of(left_factors(m.loo, m.inverse, rank)) * (b - 1) / math.sqrt(b)
            se = np.sqrt(each.var(axis=0, ddof=1))
            out |= {"se": se.tolist(), "z": [float(v / s) if s > 0 else None for v, s in zip(w, se)]}
        if full:
            out["rankdrop"], out["f4rank"] = rank_table(m, alpha)
            out["popdrop"] = dropped(m, nl, nr)
    except np.linalg.LinAlgError:
        out["status"] = "rank_deficient"
    return out


def dropped(m: Moments, nl: int, nr: int) -> list[dict]:
    """Fits of every nonempty subset of sources, on slices of the full inverse covariance."""
    rows = []
    for gone in range(nl):
        for out in itertools.combinations(range(nl), gone):
            keep = [i for i in range(nl) if i not in out]
            at = (np.array(keep)[:, None] * nr + np.arange(nr)).reshape(-1)
            rank = len(keep) - 1
            a, _, chisq = low_rank(m.total[keep], m.inverse[np.ix_(at, at)], rank)
            w = weights_of(a)
            full = [None] * nl
            for i, v in zip(keep, w):
                full[i] = float(v)
            k = dof(len(keep), nr, rank)
            rows.append({"pat": "".join("1" if i in out else "0" for i in range(nl)), "wt": gone, "dof": k, "chisq": chisq, "p": chisq_upper(chisq, k), "f4rank": rank, "weights": full, "feasible": bool((w >= 0).all() and (w <= 1).all())})
    return rows


_RANK = pa.struct([("f4rank", pa.int32()), ("dof", pa.int32()), ("chisq", pa.float64()), ("p", pa.float64()), ("dofdiff", pa.int32()), ("chisqdiff", pa.float64()), ("p_nested", pa.float64())])
_DROP = pa.struct([("pat", pa.string()), ("wt", pa.int32()), ("dof", pa.int32()), ("chisq", pa.float64()), ("p", pa.float64()), ("f4rank", pa.int32()), ("weights", pa.list_(pa.float64())), ("feasible", pa.bool_())])
_FIT = {"status": pa.string(), "weights": pa.list_(pa.float64()), "se": pa.list_(pa.float64()), "z": pa.list_(pa.float64()), "chisq": pa.float64(), "dof": pa.int32(), "p": pa.float64(), "f4rank": pa.int32(), "rankdrop": pa.list_(_RANK), "popdrop": pa.list_(_DROP)}
FIT_SCHEMA = (
    "status string, weights array<double>, se array<double>, z array<double>, chisq double, dof int, p double, f4rank int, "
    "rankdrop array<struct<f4rank:int,dof:int,chisq:double,p:double,dofdiff:int,chisqdiff:double,p_nested:double>>, "
    "popdrop array<struct<pat:string,wt:int,dof:int,chisq:double,p:double,f4rank:int,weights:array<double>,feasible:boolean>>"
)


def qpadm(models: DataFrame, tensor: DataFrame, alpha: float = 0.05, with_se: bool = True, full: bool = True) -> DataFrame:
    """model_id, target, left, right (arrays of labels) and the fit of each model.  ValueError for an unknown label is a status: `invalid_config`."""
    named = models.select(F.explode(F.concat(F.array("target"), "left", "right")).alias("p")).distinct().collect()  # labels
    pops, f2, n = dense(tensor, only={r.p for r in named if r.p is not None})
    shared = models.sparkSession.sparkContext.broadcast((pops, f2, n))

    def run(batches):
        labels, t, size = shared.value
        at = {p: i for i, p in enumerate(labels)}
        for b in batches:
            rows = b.select(["model_id", "target", "left", "right"]).to_pylist()
            fits = []
            for r in rows:
                names = [r["target"], *r["left"], *r["right"]]
                ok = all(x in at for x in names) and len(set(names)) == len(names)
                fits.append(fit(t, size, at[r["target"]], [at[x] for x in r["left"]], [at[x] for x in r["right"]], alpha, with_se, full) if ok else dict.fromkeys(_FIT) | {"status": "invalid_config"})
            own = [b.column(c) for c in ("model_id", "target", "left", "right")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([f[k] for f in fits], t_) for k, t_ in _FIT.items())], names=["model_id", "target", "left", "right", *_FIT])

    return models.select(F.col("model_id").cast("long").alias("model_id"), "target", "left", "right").mapInArrow(run, f"model_id long, target string, left array<string>, right array<string>, {FIT_SCHEMA}")


def qpwave(tensor: DataFrame, left: list[str], right: list[str], alpha: float = 0.05) -> DataFrame:
    """A row for each rank of the f4 matrix of left against right (each first label is the reference), and f4rank."""
    pops, f2, n = dense(tensor, only={*left, *right})
    at = {p: i for i, p in enumerate(pops)}
    if missing := [p for p in (*left, *right) if p not in at]:
        raise ValueError(f"unknown populations: {missing}")
    rows, best = rank_table(moments(f2, n, [at[p] for p in left], [at[p] for p in right]), alpha)
    return tensor.sparkSession.createDataFrame([(r["f4rank"], r["dof"], r["chisq"], r["p"], r["dofdiff"], r["chisqdiff"], r["p_nested"], best) for r in rows], "f4rank int, dof int, chisq double, p double, dofdiff int, chisqdiff double, p_nested double, best_rank int")


def rotation(spark: SparkSession, target: str, pool: list[str], right: list[str], least: int = 1, most: int = 3, rotate_right: bool = False) -> DataFrame:
    """Models for every source set of `least` to `most` labels; with rotate_right, pool labels that are not sources join the outgroups."""
    rows = []
    for k in range(least, most + 1):
        for left in itertools.combinations(pool, k):
            rows.append((len(rows), target, list(left), [*right, *(p for p in pool if rotate_right and p not in left)]))
    return spark.createDataFrame(rows, "model_id long, target string, left array<string>, right array<string>").repartition(max(1, min(len(rows) // 2, 2048)))


def ranked(fits: DataFrame, p_min: float = 0.05) -> DataFrame:
    """Fits in order of preference: passing (status ok, weights in [0, 1], p >= p_min), fewer sources, higher least |z|, model_id."""
    passes = (F.col("status") == "ok") & (F.col("p") >= p_min) & F.forall("weights", lambda w: (w >= 0) & (w <= 1))
    strength = F.array_min(F.transform("z", F.abs))
    return fits.withColumn("passes", F.coalesce(passes, F.lit(False))).withColumn("least_z", strength).orderBy(F.desc("passes"), F.size("left"), F.desc_nulls_last("least_z"), "model_id")


def scan(tensor: DataFrame, target: str, pool: list[str], right: list[str], *, strategy: str = "auto", width: int = 3, most: int = 4, p_min: float = 0.05, limit: int = 2_000_000, sure: bool = False) -> DataFrame:
    """Ranked fits of the source sets a strategy visits: exhaustive (auto: up to 4096 models), greedy, or beam of `width`.

    Greedy and beam grow the best sets of each size by one source; each round's models are fitted in parallel.
    """
    spark = tensor.sparkSession
    most = min(most, len(pool), len(right) - 1)
    total = sum(math.comb(len(pool), k) for k in range(1, most + 1))
    if strategy == "auto":
        strategy = "exhaustive" if total <= 4096 else "beam"
    if strategy == "exhaustive":
        if total > limit and not sure:
            raise ValueError(f"{total} models: pass sure=True")
        return ranked(qpadm(rotation(spark, target, pool, right, 1, most), tensor, full=False), p_min)
    front: list[tuple[str, ...]] = [()]
    rounds = []
    seen: set[tuple[str, ...]] = set()
    for _ in range(most):
        sets = sorted({tuple(sorted((*f, p))) for f in front for p in pool if p not in f} - seen)
        seen |= set(sets)
        if not sets:
            break
        models = spark.createDataFrame([(len(seen) - len(sets) + i, target, list(s), right) for i, s in enumerate(sets)], "model_id long, target string, left array<string>, right array<string>")
        fits = qpadm(models, tensor, full=False).persist()
        rounds.append(fits)
        best = fits.orderBy(F.desc_nulls_last("p"), "model_id").limit(1 if strategy == "greedy" else width).select("left").collect()  # at most `width`
        front = [tuple(r["left"]) for r in best]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return ranked(out, p_min)


def prerank(tensor: DataFrame, target: str, pool: list[str], right: list[str]) -> DataFrame:
    """source, score: the mean over outgroups R of f3(R; target, source), the greatest first."""
    t = tensor.filter("p1 <> p2").groupBy("p1", "p2").agg((F.sum(F.col("f2") * F.col("block_size")) / F.sum("block_size")).alias("f2"))
    both = t.unionByName(t.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "f2"))
    r = both.filter(F.col("p1").isin(right))
    a = r.filter(F.col("p2") == target).select("p1", F.col("f2").alias("rt"))
    b = r.filter(F.col("p2").isin(pool)).select("p1", F.col("p2").alias("source"), F.col("f2").alias("rs"))
    c = both.filter((F.col("p1") == target) & F.col("p2").isin(pool)).select(F.col("p2").alias("source"), F.col("f2").alias("ts"))
    return a.join(b, "p1").join(c, "source").groupBy("source").agg(F.avg((F.col("rt") + F.col("rs") - F.col("ts")) / 2).alias("score")).orderBy(F.desc("score"), "source")
