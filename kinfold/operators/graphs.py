"""Admixture graphs: fits of edge lengths and mixture weights to f3 statistics, and exhaustive search over small topologies."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.fstats import dense

Edges = list[tuple[str, str]]


@dataclass
class Graph:
    """A rooted graph whose nodes have one or two parents."""

    edges: Edges
    leaves: list[str]
    order: list[str]
    #: Nodes with two parents, and the numbers of their in-edges as listed; the weight belongs to the first.
    mixed: list[tuple[str, int, int]]


def parse(edges: Edges) -> Graph:
    """ValueError unless there is one root, no cycle, and at most two in-edges to a node."""
    nodes = list(dict.fromkeys(x for e in edges for x in e))
    into = {v: [i for i, (_, b) in enumerate(edges) if b == v] for v in nodes}
    roots = [v for v in nodes if not into[v]]
    if len(roots) != 1 or any(len(x) > 2 for x in into.values()):
        raise ValueError("one root and at most two parents are needed")
    order, left = [], {v: len(into[v]) for v in nodes}
    ready = [roots[0]]
    while ready:
        v = ready.pop(0)
        order.append(v)
        for a, b in edges:
            if a == v:
                left[b] -= 1
                if not left[b]:
                    ready.append(b)
    if len(order) != len(nodes):
        raise ValueError("the graph has a cycle")
    parents = {a for a, _ in edges}
    return Graph(edges, [v for v in nodes if v not in parents], order, [(v, *into[v]) for v in nodes if len(into[v]) == 2])


def path_weights(g: Graph, theta: np.ndarray) -> np.ndarray:
    """edges x leaves: the share of a leaf's ancestry that passes each edge."""
    share = np.ones(len(g.edges))
    for (_, i, j), t in zip(g.mixed, theta):
        share[i], share[j] = t, 1 - t
    out = np.zeros((len(g.edges), len(g.leaves)))
    for k, leaf in enumerate(g.leaves):
        mass = {leaf: 1.0}
        for v in reversed(g.order):
            if m := mass.get(v):
                for i, (a, b) in enumerate(g.edges):
                    if b == v:
                        out[i, k] += m * share[i]
                        mass[a] = mass.get(a, 0.0) + m * share[i]
    return out


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least squares of a x = b with x >= 0, by active sets on the normal equations."""
    m, y = a.T @ a, a.T @ b
    m = m + 1e-10 * max(np.trace(m), 1e-300) / len(m) * np.eye(len(m))
    x, free = np.zeros(len(y)), np.zeros(len(y), bool)
    for _ in range(rounds):
        gain = np.where(free, -np.inf, y - m @ x)
        if gain.max(initial=-np.inf) <= 1e-12 * max(np.abs(y).max(initial=0), 1e-300):
            break
        free[int(gain.argmax())] = True
        while True:
            own = np.flatnonzero(free)
            z = np.zeros(len(y))
            z[own] = np.linalg.solve(m[np.ix_(own, own)], y[own])
            if (z[own] > 0).all():
                x = z
                break
            bad = own[z[own] <= 0]
            step = (x[bad] / np.where(x[bad] - z[bad] == 0, 1, x[bad] - z[bad])).min()
            x = x + step * (z - x)
            free[own[x[own] <= 1e-15]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def fit(f2: np.ndarray, n: np.ndarray, pops: list[str], edges: Edges, diag: float = 1e-5, starts: int = 10) -> dict:
    """score, edge lengths, mixture weights and the worst residual's z of a graph whose leaves are populations."""
    g = parse(edges)
    at = [pops.index(v) for v in g.leaves]
    base, rest = at[0], at[1:]
    pairs = list(itertools.combinations_with_replacement(range(len(rest)), 2))
    x = np.stack([(f2[:, base, rest[i]] + f2[:, base, rest[j]] - f2[:, rest[i], rest[j]]) / 2 for i, j in pairs], axis=1)
    share = (n / n.sum())[:, None]
    tot = (x * share).sum(0)
    loo = (tot - x * share) / (1 - share)
    line = (loo * (1 - share)).sum(0) / (1 - share).sum()
    est = (line - loo).sum(0) + (loo * share).sum(0)
    h = 1 / share
    tau = (est * h - loo * (h - 1) - line) / np.sqrt(h - 1)
    q = tau.T @ tau / len(n)
    root = np.linalg.cholesky(np.linalg.inv(q + diag * np.trace(q) * np.eye(len(q)))).T
    target = root @ est
    drift = np.array([i not in {k for m in g.mixed for k in m[1:]} for i in range(len(edges))])

    def inner(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = path_weights(g, theta)
        d = w[:, 1:] - w[:, :1]
        design = np.stack([d[:, i] * d[:, j] for i, j in pairs])
        length = np.zeros(len(edges))
        length[drift] = nonnegative(root @ design[:, drift], target)
        fitted = design @ length
        e = root @ (est - fitted)
        return float(e @ e), length, fitted

    rng = np.random.default_rng(1)
    best = (np.inf, np.zeros(0))
    for s in range(starts if g.mixed else 1):
        theta = np.full(len(g.mixed), 0.5) if s == 0 else rng.random(len(g.mixed))
        score = inner(theta)[0]
        for _ in range(30):
            before = score
            for k in range(len(theta)):  # golden section along each weight
                lo, hi, r = 0.0, 1.0, 0.6180339887498949
                at_ = lambda v, k=k, theta=theta: inner(np.where(np.arange(len(theta)) == k, v, theta))[0]
                a, b = hi - r * (hi - lo), lo + r * (hi - lo)
                fa, fb = at_(a), at_(b)
                while hi - lo > 1e-6:
                    if fa < fb:
                        hi, b, fb = b, a, fa
                        a = hi - r * (hi - lo)
                        fa = at_(a)
                    else:
                        lo, a, fa = a, b, fb
                        b = lo + r * (hi - lo)
                        fb = at_(b)
                v = (lo + hi) / 2
                if at_(v) <= score:
                    theta = np.where(np.arange(len(theta)) == k, v, theta)
                    score = at_(v)
            if before - score < 1e-8 * max(1, before):
                break
        if score < best[0]:
            best = score, theta
    score, length, fitted = inner(best[1])
    se = np.sqrt(np.diag(q))
    z = (est - fitted) / np.where(se > 0, se, np.nan)
    weight = [None] * len(edges)
    for (_, i, j), t in zip(g.mixed, best[1]):
        weight[i], weight[j] = float(t), float(1 - t)
    return {"score": score, "worst_z": float(z[np.nanargmax(np.abs(z))]), "lengths": length.tolist(), "weights": weight}


def qpgraph(graphs: DataFrame, tensor: DataFrame, starts: int = 10) -> DataFrame:
    """graphs: graph_id, edges (array of struct<from, to>, in order).  Adds score, worst_z, lengths, weights, status; graphs are fitted side by side."""
    named = graphs.select(F.explode("edges").alias("e")).select(F.explode(F.array("e.from", "e.to")).alias("p")).distinct().collect()  # labels and inner names
    pops, f2, n = dense(tensor, only={r.p for r in named if r.p is not None})
    shared = graphs.sparkSession.sparkContext.broadcast((pops, f2, n))

    def run(batches):
        labels, t, size = shared.value
        for b in batches:
            rows = []
            for edges in b.column("edges").to_pylist():
                try:
                    rows.append(fit(t, size, labels, [(e["from"], e["to"]) for e in edges], starts=starts) | {"status": "ok"})
                except (ValueError, np.linalg.LinAlgError) as e:
                    rows.append({"score": None, "worst_z": None, "lengths": None, "weights": None, "status": "rank_deficient" if isinstance(e, np.linalg.LinAlgError) else "invalid_config"})
            yield pa.RecordBatch.from_arrays([b.column("graph_id"), b.column("edges"), *(pa.array([r[k] for r in rows], t_) for k, t_ in (("score", pa.float64()), ("worst_z", pa.float64()), ("lengths", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64())), ("status", pa.string())))], names=["graph_id", "edges", "score", "worst_z", "lengths", "weights", "status"])

    return graphs.select(F.col("graph_id").cast("long").alias("graph_id"), "edges").mapInArrow(run, "graph_id long, edges array<struct<from:string,to:string>>, score double, worst_z double, lengths array<double>, weights array<double>, status string")


def _canonical(edges: Edges) -> str:
    """A string that graphs alike but for inner names share (enough for trees and one mixture)."""
    g = parse(edges)
    name = {v: v for v in g.leaves}
    for _ in range(len(g.order)):
        for v in reversed(g.order):
            if v not in g.leaves:
                name[v] = "(" + ",".join(sorted(name.get(b, "?") for a, b in edges if a == v)) + ")"
    return "|".join(sorted(f"{name[a]}>{name[b]}" for a, b in edges))


def topologies(leaves: list[str], mixtures: int = 0) -> list[Edges]:
    """Every rooted binary tree of the leaves, the first as outgroup, and with `mixtures` = 1 also every one-mixture graph over them."""
    trees: list[Edges] = [[("R", leaves[0]), ("R", leaves[1])]] if len(leaves) > 1 else []
    for k, leaf in enumerate(leaves[2:]):
        grown = []
        for t in trees:
            for i, (a, b) in enumerate(t):
                if (a, b) == ("R", leaves[0]):
                    continue
                node = f"n{k}"
                grown.append([*t[:i], (a, node), (node, b), (node, leaf), *t[i + 1 :]])
        trees = grown
    out = {_canonical(t): t for t in trees}
    if mixtures:
        for t in list(out.values()):
            for i, j in itertools.permutations(range(len(t)), 2):
                (a, b), (c, d) = t[i], t[j]  # the node above b takes a second parent on the edge c-d
                g = [e for k, e in enumerate(t) if k not in (i, j)] + [(a, "mix"), ("x", "mix"), ("mix", b), (c, "x"), ("x", d)]
                try:
                    key = _canonical(g)
                except ValueError:
                    continue
                if len({e for e in g}) == len(g) and (a != c or b == d or True):
                    out.setdefault(key, g)
    return list(out.values())


def search(spark: SparkSession, tensor: DataFrame, leaves: list[str], mixtures: int = 1, starts: int = 3) -> DataFrame:
    """Fits of all topologies in order of score."""
    rows = [(i, [{"from": a, "to": b} for a, b in t]) for i, t in enumerate(topologies(leaves, mixtures))]
    graphs = spark.createDataFrame(rows, "graph_id long, edges array<struct<from:string,to:string>>").repartition(max(1, min(len(rows) // 4, 512)))
    return qpgraph(graphs, tensor, starts).orderBy(F.asc_nulls_last("score"), "graph_id")
