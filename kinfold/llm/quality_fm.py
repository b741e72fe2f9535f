"""Quality scoring by a factorisation machine (operator 2).

A text's features are its hashed words, its hashed word shapes (runs of character classes), structure statistics and its
length.  Score = logistic(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise
interactions of rank `RANK` in time linear in the features, by the sum-of-squares identity.

The model is fitted on the driver from at most `PER_LABEL` labelled rows of each label (those of least hash of doc_id);
labels, lang, source and doc_id are no features.  Scoring reads every whole text once, in bounded Arrow slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import documents, hash_ranges, materialize, mix, per_slice, prefix_hash, range_hash, slices, text_bytes

RANK = 8
BUCKETS = 1 << 15
#: Labelled rows of each label that the model is fitted on, at most.
PER_LABEL = 2500
#: Features of those rows together, at most, for each label (8 bytes each): very long texts leave room for fewer rows.
FEATURES = 6_000_000
THRESHOLD = 0.7
EPOCHS = 6

#: Structure statistics, behind the buckets of words and of shapes.
STATS = ("upper", "digit", "mark", "space", "wide", "line", "distinct", "word_length", "length", "tiny", "mark_words", "repeat")
SIZE = 2 * BUCKETS + len(STATS)

_CLASS = np.full(256, 4, np.uint8)  # marks stand for themselves
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHAPE = np.where(_CLASS == 4, np.arange(256) + 8, _CLASS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)


def featurize(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: features of each text begin at `first`, ids, values.  An empty text has one feature, of value 0."""
    n = len(off) - 1
    size = np.diff(off)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(off, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    hashed = hash_ranges(data, start, end) % np.uint64(BUCKETS)
    kind = _CLASS[data]
    token = np.where(kind == 4, data + 8, kind)
    head = np.zeros(len(data), bool)
    head[start] = True
    turn = ~space & (head | np.concatenate(([True], token[1:] != token[:-1]))) if len(data) else head
    place = np.concatenate(([0], np.cumsum(turn)))
    shapes = mix(range_hash(prefix_hash(_SHAPE[data[turn]]), place[start], place[end])) % np.uint64(BUCKETS) if len(start) else np.zeros(0, np.uint64)
    key = np.concatenate((doc * (2 * BUCKETS) + hashed.astype(np.int64), doc * (2 * BUCKETS) + BUCKETS + shapes.astype(np.int64)))
    key, count = np.unique(key, return_counts=True)
    row, ids = np.divmod(key, 2 * BUCKETS)
    values = np.sqrt(count / np.maximum(words[row], 1))

    def share(flags: np.ndarray, among: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flags)))
        return (c[off[1:]] - c[off[:-1]]) / np.maximum(among, 1)

    distinct = np.bincount(row[ids < BUCKETS], minlength=n)
    length = end - start
    marked = kind[end - 1] == 4 if len(end) else np.zeros(0, bool)
    pair = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1]))) if len(doc) else marked
    per_word = lambda f: np.bincount(doc, f, n) / np.maximum(words, 1)
    stats = np.stack(
        [
            share(kind == 1, size), share(kind == 2, size), share((kind == 4) & ~space, size), share(space, size), share(data >= 128, size), share(data == 10, words),
            distinct / np.maximum(words, 1), np.minimum(per_word(length) / 20, 2), np.log1p(size) / 12, per_word(length <= 2), per_word(marked), per_word(pair),
        ], axis=1,
    )
    rows = np.concatenate((row, np.repeat(np.arange(n), len(STATS))))
    ids = np.concatenate((ids, np.tile(np.arange(len(STATS)) + 2 * BUCKETS, n)))
    values = np.concatenate((values, stats.reshape(-1)))
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n)), ids[order].astype(np.int32), values[order].astype(np.float32)


class Machine:
    """w0, w (SIZE) and v (SIZE x RANK)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, first: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(first):
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx.astype(np.float64), first, axis=0)
        q = np.add.reduceat(np.square(vx, dtype=np.float64).sum(axis=1), first)
        return self.w0 + np.add.reduceat((self.w[ids] * x).astype(np.float64), first) + (np.square(s).sum(axis=1) - q) / 2, s

    def score(self, first: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, ids, x)[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-5) -> Machine:
    """AdaGrad on the logistic loss, rows weighted so that both labels count alike; without both labels, a constant."""
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(SIZE, np.float32), (rng.standard_normal((SIZE, rank)) * 0.02).astype(np.float32))
    if not len(labels) or labels.min() == labels.max():
        m.w0 = 3.0 if not len(labels) or labels[0] else -3.0
        m.v[:] = 0
        return m
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    g0, gw, gv = 1e-3, np.full(SIZE, 1e-3, np.float32), np.full((SIZE, rank), 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            ids, x = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            n = np.array([len(rows[i][0]) for i in some])
            first = np.cumsum(n) - n
            raw, s = m.raw(first, ids, x)
            d = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            dx = np.repeat(d, n) * x
            uniq, inverse = np.unique(ids, return_inverse=True)
            order_i = np.argsort(inverse, kind="stable")
            heads = np.searchsorted(inverse[order_i], np.arange(len(uniq)))
            dw = np.add.reduceat(dx[order_i], heads) + decay * m.w[uniq]
            each = dx[:, None] * (np.repeat(s, n, axis=0).astype(np.float32) - m.v[ids] * x[:, None])
            dv = np.add.reduceat(each[order_i], heads, axis=0) + decay * m.v[uniq]
            g0 += float(d.sum()) ** 2
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            m.w0 -= rate * float(d.sum()) / g0**0.5
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
    return m


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, features: int = FEATURES) -> Machine:
    """Fits on labelled rows whose crc32(doc_id as text) mod 4 is not 2: of each label the `per_label` of least hash, as far as they have `features` features.

    Rows without a doc_id or a quality of 0 or 1 are no labels; null texts count as empty.  Of labels that differ for one
    doc_id the lesser counts; rows that share a doc_id are all learnt from.  Without any label, or with one value only, the
    model is a constant.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    by_hash = F.xxhash64("doc_id")
    sample = None
    for q in (0, 1):
        own = known.filter(F.col("quality") == q).orderBy(by_hash, "doc_id").limit(per_label)
        sample = own if sample is None else sample.unionByName(own)
    # at most 2 * per_label rows of two numbers: a proven bound for the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def work(batches):
        for b in batches:
            for part in slices(b):
                first, ids, x = featurize(*text_bytes(part.column("text")))
                cut = first[1:]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([i.tobytes() for i in np.split(ids, cut)], pa.binary()), pa.array([v.tobytes() for v in np.split(x, cut)], pa.binary())], names=["doc_id", "quality", "ids", "x"])

    found = materialize(rows.select("doc_id", "quality", "text").mapInArrow(work, "doc_id long, quality int, ids binary, x binary"))
    # a window over the sample, not over the corpus
    before = F.sum(F.octet_length("ids") / 4).over(Window.partitionBy("quality").orderBy(by_hash, "doc_id", F.xxhash64("ids")).rowsBetween(Window.unboundedPreceding, 0))
    got = found.withColumn("before", before).filter(F.col("before") <= features).drop("before").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got.column("ids").to_pylist(), got.column("x").to_pylist())]
    return fit(pairs, np.array(got.column("quality").to_pylist(), np.int64))


def score(docs: DataFrame, model: Machine, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, and the columns named in `keep`: one row per row of `docs`, whatever its doc_id.

    A null text scores as an empty one, equal texts score alike, and no score is null.  An empty table gives no rows; other
    columns of `docs`, whatever their names, are not read.  A text is held whole by one worker.
    """
    w0, w, v = model.w0, model.w, model.v
    shared = docs.sparkSession.sparkContext.broadcast((w0, w, v))  # of fixed size

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        s = Machine(*shared.value).score(*featurize(*text_bytes(part.column("text"))))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), *(part.column(c) for c in keep)], names=["doc_id", "score", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(["doc_id long", "score double", *(f"`{c}` {kinds[c]}" for c in keep)])
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return per_slice(rows, work, schema, tuple(dict.fromkeys(("doc_id", "text", *keep))))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score` of every whole text of `documents` by a model fitted to `labels`; a null doc_id is not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
