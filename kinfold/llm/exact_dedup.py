"""Exact dedup by composable polynomial fingerprints (operator 10).

A text's fingerprint is the value at BASE of the polynomial whose coefficients are its bytes, modulo 2**61 - 1, together
with its length.  Chunks are hashed independently (a matrix product over all chunks of a text) and combine by
length-shifted arithmetic: ``H(ab) = H(a) * BASE**len(b) + H(b)``.  Texts with equal fingerprints are then compared chunk
by chunk: per (fingerprint, chunk) only the least and the greatest chunk are carried, so a group of any size is compared
in a stream with map-side combining; a fingerprint whose chunks differ is split by SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import documents, materialize, per_slice, rows_of, text_bytes

P61 = (1 << 61) - 1
BASE = 0x0123456789ABCDEF
#: Bytes of a chunk: small enough that the float64 products below stay exact (255 * 2**31 * 2**14 < 2**53).
CHUNK = 1 << 14
#: Bytes of a compared chunk.
COMPARE = 1 << 14
#: A-Z to a-z, nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _weights() -> tuple[np.ndarray, np.ndarray]:
    w, x = [], 1
    for _ in range(CHUNK):
        w.append(x)
        x = x * BASE % P61
    lo = np.array([v & ((1 << 30) - 1) for v in reversed(w)], np.float64)
    hi = np.array([v >> 30 for v in reversed(w)], np.float64)
    return lo, hi


_LO, _HI = _weights()


def combine(a: int, b: int, b_length: int) -> int:
    """Fingerprint of a text whose first part has fingerprint `a` and whose last `b_length` bytes have `b`."""
    return (a * pow(BASE, b_length, P61) + b) % P61


def chunk_hashes(data: np.ndarray) -> list[int]:
    """Hashes of the consecutive CHUNK-byte pieces of `data`; the last may be shorter."""
    whole = len(data) // CHUNK
    out: list[int] = []
    if whole:
        m = data[: whole * CHUNK].reshape(whole, CHUNK).astype(np.float64)
        out += [(int(a) + (int(b) << 30)) % P61 for a, b in zip(m @ _LO, m @ _HI)]
    if rest := len(data) - whole * CHUNK:
        f = data[whole * CHUNK :].astype(np.float64)
        out.append((int(f @ _LO[-rest:]) + (int(f @ _HI[-rest:]) << 30)) % P61)
    return out


def fingerprint(data: np.ndarray) -> int:
    total, at = 0, 0
    for h in chunk_hashes(data):
        n = min(CHUNK, len(data) - at)
        total = combine(total, h, n)
        at += n
    return total


_KEYS = pa.schema([("doc_id", pa.int64()), ("ident", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary())])
_CHUNKS = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary())])


def _keys(part: pa.RecordBatch) -> pa.RecordBatch:
    data, off = text_bytes(part.column("text"))
    data = LOWER[data]
    fp, sha = [], []
    for s, e in zip(off[:-1], off[1:]):
        fp.append(fingerprint(data[s:e]))
        sha.append(hashlib.sha256(data[s:e]).digest())
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ident"), pa.array(fp, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(sha, pa.binary())], schema=_KEYS)


def _chunks(part: pa.RecordBatch) -> pa.RecordBatch:
    data, off = text_bytes(part.column("text"))
    data = LOWER[data]
    rows: list[tuple[int, int, int, bytes]] = []
    for fp, s, e in zip(part.column("fp").to_pylist(), off[:-1], off[1:]):
        rows += [(fp, int(e - s), k, data[a : min(a + COMPARE, e)].tobytes()) for k, a in enumerate(range(int(s), int(e), COMPARE))]
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CHUNKS)], schema=_CHUNKS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    The largest doc_id of a group stays (a null doc_id only if the group has no other; keep_id is then null).  Rows that
    repeat both doc_id and text all count in group_size and get the same answer.  An empty table gives no rows.
    """
    rows = rows_of(docs)
    keys = materialize(per_slice(rows, _keys, "doc_id long, ident long, fp long, n_bytes long, sha binary", ("doc_id", "ident", "text")))
    key = ["fp", "n_bytes"]
    shared = keys.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1 AND n_bytes > 0").select(*key)
    members = keys.join(shared, key, "left_semi").select("ident", "fp").distinct()
    texts = rows.join(members, "ident").select("text", "fp")
    differing = per_slice(texts, _chunks, "fp long, n_bytes long, chunk_no long, chunk binary", ("text", "fp")).groupBy("fp", "n_bytes", "chunk_no").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter(F.col("a") != F.col("b")).select(*key).distinct()
    differing = materialize(differing).withColumn("split", F.lit(True))
    split = keys.join(differing, key, "left").withColumn("part", F.when(F.col("split"), F.col("sha")).otherwise(F.lit(b""))).drop("split")
    groups = split.groupBy(*key, "part").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return split.join(groups, [*key, "part"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`exact_dedup` of every whole text of `documents`."""
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
