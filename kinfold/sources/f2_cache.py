"""The f2 tensor on disk: Parquet with a metadata file, and the binary form other tools read."""

from __future__ import annotations

import hashlib
import json
import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.fstats import dense

#: Fixed values of the binary format.
MAGIC, VERSION, FP64, HEADER = b"STPF2BK1", 1, 1, 64


def write_cache(tensor: DataFrame, path: str, **provenance) -> None:
    """tensor.parquet and meta.json (populations, blocks, checksum of the sorted rows' hashes)."""
    tensor.write.mode("errorifexists").parquet(f"{path}/tensor.parquet")
    meta = describe(tensor.sparkSession, path) | {"provenance": provenance}
    with open(os.path.join(path, "meta.json"), "w") as f:
        json.dump(meta, f, indent=1, sort_keys=True)


def describe(spark: SparkSession, path: str) -> dict:
    from pyspark.sql import functions as F

    t = spark.read.parquet(f"{path}/tensor.parquet")
    r = t.agg(F.count_distinct("block_id").alias("blocks"), F.sort_array(F.collect_set("p1")).alias("pops"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*sorted(t.columns))).alias("checksum")).first()
    return {"pops": list(r["pops"]), "blocks": r["blocks"], "rows": r["rows"], "checksum": r["checksum"]}


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tensor.parquet")


def list_caches(root: str) -> list[str]:
    return sorted(d for d in os.listdir(root) if os.path.exists(os.path.join(root, d, "meta.json")))


def verify_cache(spark: SparkSession, path: str) -> bool:
    """Whether the tensor is the one its metadata describes."""
    with open(os.path.join(path, "meta.json")) as f:
        meta = json.load(f)
    now = describe(spark, path)
    return all(meta[k] == v for k, v in now.items())


def write_binary(tensor: DataFrame, path: str) -> str:
    """path/f2.bin and path/pops.txt; returns the file's SHA-256.  The tensor's size is bounded by `dense`."""
    pops, f2, n = dense(tensor)
    b, p = f2.shape[:2]
    size = b * p * p * 8
    head = struct.pack("<8sIIiiQQQ16x", MAGIC, VERSION, FP64, p, b, HEADER, HEADER + size, HEADER + 2 * size)
    pairs = np.repeat(n[:, None], p * p, axis=1)  # block-wise counts of variants stand for pair counts
    data = head + f2.astype("<f8").tobytes() + pairs.astype("<f8").tobytes() + n.astype("<i4").tobytes()
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "f2.bin"), "wb") as f:
        f.write(data)
    with open(os.path.join(path, "pops.txt"), "w") as f:
        f.write("".join(x + "\n" for x in pops))
    return hashlib.sha256(data).hexdigest()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """block_id, p1, p2, f2, vpair, block_size for p1 <= p2."""
    with open(os.path.join(path, "f2.bin"), "rb") as f:
        data = f.read()
    with open(os.path.join(path, "pops.txt")) as f:
        pops = f.read().split()
    magic, version, kind, p, b, at, pair_at, size_at = struct.unpack_from("<8sIIiiQQQ", data)
    if magic != MAGIC or version != VERSION or kind != FP64 or p != len(pops):
        raise ValueError("not an f2 file of this version")
    f2 = np.frombuffer(data, "<f8", b * p * p, at).reshape(b, p, p)
    pairs = np.frombuffer(data, "<f8", b * p * p, pair_at).reshape(b, p, p)
    sizes = np.frombuffer(data, "<i4", b, size_at)
    order = sorted(range(p), key=lambda i: pops[i])
    rows = [(k, pops[i], pops[j], float(f2[k, i, j]), int(pairs[k, i, j]), int(sizes[k])) for k in range(b) for x, i in enumerate(order) for j in order[x:]]
    return spark.createDataFrame(rows, "block_id int, p1 string, p2 string, f2 double, vpair long, block_size long")
