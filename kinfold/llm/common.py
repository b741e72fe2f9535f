"""Shared pieces: scratch tables, Arrow batching, rolling hashes and the packed hash exchange."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one worker holds in numpy form at a time (a single longer text is held whole).
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the cluster's shared checkpoint folder (a temporary one where none is named and all is one process, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="kinfold-")  # driver and executors are one process
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/kinfold-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, on whatever file system holds it; a session that has ended is left alone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # at exit the gateway may be gone; the folder is the cluster's scratch space
        return


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing will read again."""
    drop_path(df.sparkSession, df._scratch)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files of finished passes (it acts when the driver's JVM collects)."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and n+1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive row ranges of a batch, each of about `limit` bytes of text or one longer row."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system; the allocators of a worker, which Spark uses again, else keep what its largest batches took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def per_slice(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str, columns: Iterable[str] = ("doc_id", "text"), limit: int = SLICE_BYTES, lean: bool = False) -> DataFrame:
    """Map Arrow slices of about `limit` bytes of text; columns that aren't named never leave the scan.

    lean: a worker gives freed memory back after each batch, and so before it waits for its next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                out = work(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
            if lean:
                batch = part = out = None
                give_back()

    return df.select(*columns).mapInArrow(run, schema)


# ---- rolling hashes -------------------------------------------------------------------------------------------------
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 << 20:
            return have
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes don't keep linear structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """c with c[e]-c[s] = sum of values[i] * base**i over s <= i < e, modulo 2**64."""
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of the values in [start, end), whatever stands before."""
    return (c[end] - c[start]) * powers(len(c), base)[1][start]


#: A second base, for hashes that must not agree by chance.
SECOND_BASE = 0xD1342543DE82EF95


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE, block: int = 1 << 18) -> np.ndarray:
    """Hashes of byte ranges in rising order that don't overlap, block by block, so that few prefix sums are held at a time."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + block, "right")), i + 1)
        a = start[i]
        out[i:j] = mix(range_hash(byte_hash(data[a : end[j - 1]], base), start[i:j] - a, end[i:j] - a, base))
        i = j
    return out


def byte_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    return prefix_hash(_TABLE[data], base)


def check_bits(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """16 further bits of the hash of [start, end), from prefix sums of SECOND_BASE."""
    return (mix(range_hash(c, start, end, SECOND_BASE)) >> np.uint64(48)).astype(np.uint16)


# ---- packed hash exchange -------------------------------------------------------------------------------------------
#: Stands for a null doc_id in comparisons: a null is the smallest.
NULL_DOC = -(2**63)
PACKED = "r int, payload binary"
REPLY = "home int, payload binary"
PACKED_SCHEMA = pa.schema([("r", pa.int32()), ("payload", pa.binary())])
REPLY_SCHEMA = pa.schema([("home", pa.int32()), ("payload", pa.binary())])
#: Key bits that a narrow key keeps: enough where equal keys of different strings do no more than cost work.
NARROW = np.uint64((1 << 48) - 1)


def ident_of(docs: DataFrame) -> Column:
    """A bigint that names a row: rows that share a doc_id but not the text are rows of their own.

    Where doc_id is a key (never null, repeated or negative, which one small aggregation tells), it is doc_id itself, which
    travels best; else a negative hash of doc_id and text.  Rows that agree in both have one ident; they are alike in every
    place and get the same answers.
    """
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    odd = docs.select(doc.alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter("n > 1 OR d IS NULL OR d < 0")
    if odd.isEmpty():
        return doc
    return F.xxhash64(F.coalesce(doc, F.lit(NULL_DOC)), F.coalesce(text, F.lit(""))).bitwiseOR(F.lit(-(2**63)))


def rows_of(docs: DataFrame, ident: Column | None = None) -> DataFrame:
    """doc_id (bigint), text, and `ident`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (ident_of(docs) if ident is None else ident).alias("ident"))


def column_of(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A bigint column; nulls as NULL_DOC."""
    col = table.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.fill_null(NULL_DOC).to_numpy(zero_copy_only=False), np.int64)


def _steps(v: np.ndarray) -> bytes:
    """Whole numbers as their first one and differences, of as few bytes as they take."""
    v = np.asarray(v, np.int64)
    step = np.diff(v)
    far = max(int(step.max()), -int(step.min())) if len(step) else 0
    size = 2 if far < 1 << 15 else 4 if far < 1 << 31 else 8
    return bytes([size]) + (v[:1] if size < 8 else v).tobytes() + (step.astype(f"<i{size}") if size < 8 else v[:0]).tobytes()


def _unstep(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = blob[at]
    if size == 8 or not n:
        return np.frombuffer(blob, "<i8", n, at + 1), at + 1 + 8 * n
    step = np.frombuffer(blob, f"<i{size}", n - 1, at + 9)
    return np.cumsum(np.concatenate((np.frombuffer(blob, "<i8", 1, at + 1), step)), dtype=np.int64), at + 9 + size * (n - 1)


def pack(runs: dict[str, np.ndarray], columns: dict[str, np.ndarray]) -> bytes:
    """Columns stored one after another.  Columns in `runs` change together and seldom: each stretch is stored once; `pos` as steps."""
    lead = next(iter(runs.values()))
    n = len(lead)
    at = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1]))) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(at, n))
    short = not n or int(count.max()) < 256
    out = [n.to_bytes(4, "little"), len(at).to_bytes(4, "little"), bytes([short]), count.astype("u1" if short else "<u4").tobytes()]
    out += [_steps(v[at]) for v in runs.values()]
    out += [_steps(v) if k == "pos" else np.ascontiguousarray(v).tobytes() for k, v in columns.items()]
    return b"".join(out)


def unpack(blob: bytes, runs: tuple[str, ...], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    n, m, short, out = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little"), blob[8], {}
    counts, at = np.frombuffer(blob, "u1" if short else "<u4", m, 9), 9 + (m if short else 4 * m)
    for k in runs:
        values, at = _unstep(blob, at, m)
        out[k] = np.repeat(values, counts)
    for k, d in dtypes.items():
        if k == "pos":
            values, at = _unstep(blob, at, n)
            out[k] = values.astype(d)
        else:
            out[k] = np.frombuffer(blob, d, n, at)
            at += n * np.dtype(d).itemsize
    return out


NARROW_COLUMNS = {"pos": "<u4", "low": "<u4", "high": "<u2", "tag": "u1"}
WIDE_COLUMNS = {"pos": "<u4", "key": "<u8", "check": "<u2", "tag": "u1"}


def read_entries(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """ident, doc, pos, key, check and tag of all blobs; a blob's first byte tells wide keys (1) and whether it names the doc (2)."""
    parts = []
    for b in blobs:
        p = unpack(b[1:], ("ident", "doc") if b[0] & 2 else ("ident",), WIDE_COLUMNS if b[0] & 1 else NARROW_COLUMNS)
        if not b[0] & 1:
            p["key"] = p.pop("low").astype(np.uint64) | (p.pop("high").astype(np.uint64) << np.uint64(32))
            p["check"] = np.zeros(len(p["tag"]), np.uint16)
        parts.append(p)
    return {c: np.concatenate([p[c] for p in parts]) for c in ("ident", "doc", "pos", "key", "check", "tag") if c in parts[0]}


def blobs_by(groups: np.ndarray, make: Callable[[np.ndarray], bytes], schema: pa.Schema) -> pa.RecordBatch:
    """One row for each group: its number and what `make` packs of the places that belong to it, in their order."""
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    cuts = np.flatnonzero(np.diff(g)) + 1
    ends = np.concatenate((cuts, [len(g)])) if len(g) else cuts
    starts = np.concatenate(([0], cuts)) if len(g) else cuts
    blobs = [make(order[s:e]) for s, e in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(g[starts], pa.int32()), pa.array(blobs, pa.binary())], schema=schema)


def reply_rows(home: np.ndarray, ident: np.ndarray, pos: np.ndarray, tag: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    order = np.lexsort((pos, ident))
    home, ident, pos, tag = home[order], ident[order], pos[order].astype("<u4"), tag[order].astype("u1")
    return blobs_by(home, lambda i: pack({"ident": ident[i]}, {"pos": pos[i], "tag": tag[i]}), schema)


def xxhash64_long(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a bigint (XXH64 of its eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ (rot(x.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        return h ^ (h >> np.uint64(32))


def homes_of(ident: np.ndarray, homes: int | None) -> np.ndarray:
    """The home of each row; without a number of homes `ident` is the home itself."""
    return ident if homes is None else xxhash64_long(ident).view(np.int64) % np.int64(homes)


def home_column(homes: int):
    return F.pmod(F.xxhash64("ident"), F.lit(homes).cast("long")).cast("int")


def _repeated(key: np.ndarray, check: np.ndarray | None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys (and checks) stand together, and flags of the first of each; `last` orders within equal ones."""
    order = np.argsort(key, kind="stable") if last is None else np.lexsort((last, key))
    k = key[order]
    head = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    if check is not None:
        c = check[order]
        if (~head[1:] & (c[1:] != c[:-1])).any():  # different strings of one key
            order = np.lexsort((check, key)) if last is None else np.lexsort((last, check, key))
            k, c = key[order], check[order]
            head = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    return order, head


def _not_first(key: np.ndarray, check: np.ndarray, doc: np.ndarray, ident: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Flags of the entries whose key also stands in a smaller doc, or earlier in the same row."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((pos, ident, doc, check, key))
    k, c, d, i, p = (a[order] for a in (key, check, doc, ident, pos))
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    row = new | np.concatenate(([True], (i[1:] != i[:-1]) | (d[1:] != d[:-1])))
    at = np.arange(len(k))
    least, own = d[np.maximum.accumulate(np.where(new, at, 0))], p[np.maximum.accumulate(np.where(row, at, 0))]
    out = np.zeros(len(k), bool)
    out[order] = (d > least) | (p > own)
    return out


def entries(key: np.ndarray, check: np.ndarray | None, row: np.ndarray, pos: np.ndarray, ident: np.ndarray, doc: np.ndarray, reducers: int, homes: int | None, first: bool = False, known: np.ndarray | None = None, copies: bool = False) -> pa.RecordBatch:
    """Packed rows that ask which keys occur more than once (or, with `first`, which places aren't a key's first).

    row: the place of each entry's row in `ident` and `doc`, never falling.  check: further bits of the key; without it
    keys are narrow.  Keys that repeat within this slice are answered here: their first place asks on behalf of all, so that
    a key which fills the corpus sends one entry from each slice.  known: entries that tell others a key is repeated and need
    no answer but, with a tag of 2, that they were of use.  copies: the reducers mark one place of each repeated key, which must
    then not be answered here as well.
    """
    if check is None:
        key = key & NARROW
    if first:
        told = _not_first(key, check, doc[row], ident[row], pos)
        ask = np.flatnonzero(~told)
        if len(np.unique(ident)) < len(ident):  # of rows that agree in all, one asks
            by = np.lexsort((pos[ask], ident[row[ask]], key[ask]))
            k, i, p = key[ask][by], ident[row[ask]][by], pos[ask][by]
            ask = np.sort(ask[by][np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1])))]) if len(ask) else ask
        tags = np.zeros(len(ask), np.uint8)
        told = np.flatnonzero(told)
    else:
        order, head = _repeated(key, check, known)
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, len(key)))
        tell = ~head if copies else ~np.repeat(count == 1, count)
        told = order[tell]
        if known is not None:
            told = told[~known[told]]
        ask = order[at]
        tags = np.where(count > 1, 1, 0).astype(np.uint8)
        if known is not None:
            tags = np.where(known[ask], 2, tags).astype(np.uint8)
        by = np.argsort(ask)
        ask, tags = ask[by], tags[by]
    k, r, p = key[ask], row[ask], pos[ask].astype("<u4")
    runs = {"ident": ident[r]} | ({"doc": doc[r]} if first else {})
    if check is None:
        columns = {"pos": p, "low": k.astype("<u4"), "high": (k >> np.uint64(32)).astype("<u2"), "tag": tags}
    else:
        columns = {"pos": p, "key": k, "check": check[ask].astype("<u2"), "tag": tags}
    kind = bytes([(check is not None) + 2 * first])
    make = lambda i: kind + pack({c: v[i] for c, v in runs.items()}, {c: v[i] for c, v in columns.items()})
    asked = blobs_by(((k & np.uint64(0xFFFFFFFF)) % np.uint64(reducers)).astype(np.int64), make, PACKED_SCHEMA)
    if not len(told):
        return asked
    own = reply_rows(-1 - homes_of(ident[row[told]], homes), ident[row[told]], pos[told], np.zeros(len(told), np.uint8), PACKED_SCHEMA)
    return pa.Table.from_batches([asked, own]).combine_chunks().to_batches()[0]


def answer(asked: DataFrame, homes: int | None, first: bool = False) -> DataFrame:
    """Rows (home, payload) that name the places `entries` asked for.

    Tag 1 marks one place of each repeated key; tag 2 a place that was known before and whose key others asked for.
    """

    def work(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        blobs = table.column("payload").to_pylist()
        if r < 0:
            return pa.table([pa.array([-1 - r] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], schema=REPLY_SCHEMA)
        e = read_entries(blobs)
        if first:
            told = np.flatnonzero(_not_first(e["key"], e["check"], e["doc"], e["ident"], e["pos"]))
            tag = np.zeros(len(told), np.uint8)
        else:
            order, head = _repeated(e["key"], e["check"], None if not e["tag"].any() else e["tag"] == 2)
            at = np.flatnonzero(head)
            count = np.diff(np.append(at, len(order)))
            again = (count > 1) | (np.maximum.reduceat(e["tag"][order], at) > 0)
            asks = np.repeat(np.minimum.reduceat(e["tag"][order], at) < 2, count)
            some = np.repeat(again, count) & ((e["tag"][order] < 2) | asks)
            told = order[some]
            tag = np.where(e["tag"][told] == 2, 2, head[some]).astype(np.uint8)
        ident = e["ident"][told]
        return pa.Table.from_batches([reply_rows(homes_of(ident, homes), ident, e["pos"][told], tag, REPLY_SCHEMA)])

    return asked.groupBy("r").applyInArrow(work, REPLY)


REPLY_COLUMNS = {"pos": "<u4", "tag": "u1"}


def replies(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ident, pos, tag of all blobs of a home."""
    parts = [unpack(b, ("ident",), REPLY_COLUMNS) for b in blobs]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    return tuple(np.concatenate([p[c] for p in parts]) for c in ("ident", "pos", "tag"))


def at_homes(rows: DataFrame, told: DataFrame, homes: int, work: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Brings each home's rows (doc_id, text, ident) and the blobs it was told together; rows come in order of ident."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left.sort_by("ident").combine_chunks(), right.column("payload").to_pylist())

    own = rows.select(home_column(homes).alias("home"), "doc_id", "text", "ident")
    return own.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(run, schema)


def extent(docs: DataFrame, per_home: int = SLICE_BYTES) -> tuple[int, int]:
    """Homes of about `per_home` bytes of text for all documents, and reducers of about four times as much."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-total // per_home)), max(16, -(-total // (4 * per_home)))


def marks(idents: np.ndarray, first: np.ndarray, ident: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """A flag for each place of the concatenated rows that (ident, pos) name; `first`: where each row begins; `idents` is sorted."""
    out = np.zeros(size, bool)
    lo, hi = np.searchsorted(idents, ident, "left"), np.searchsorted(idents, ident, "right")
    n = hi - lo
    row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[first[row] + np.repeat(pos, n).astype(np.int64)] = True
    return out


def cover(start: np.ndarray, length: int, size: int) -> np.ndarray:
    """Flags of all places within `length` of a start."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + length, size), -1)
    return np.cumsum(step[:-1]) > 0
