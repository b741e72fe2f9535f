"""Repeated word windows by level-wise doubling (operator 8).

A window of 20 words can only repeat if its windows of 10 and of 5 do.  Level 1 hashes windows of 5 words, but only those
that are the least of the 16 in some window of 20 (content chooses them, so equal windows choose alike).  Windows whose
least part repeats are extended to twice that length, again by chosen parts, and only what survives is hashed at
full length.  Each level sends packed hashes to reducers and flags back to the documents' homes; a slice asks once for
each distinct hash, whatever its frequency.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import BASE, PACKED, SECOND_BASE, answer, at_homes, check_bits, column_of, cover, documents, entries, extent, hash_ranges, marks, materialize, mix, per_slice, prefix_hash, range_hash, release_shuffles, replies, rows_of, text_bytes

WINDOW = 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of consecutive documents: byte ranges, hashes, and where each document's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        space = SPACE[data]
        if len(data):
            self.start = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
            self.end = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        self.data = data

    def hash(self, base: int = BASE) -> np.ndarray:
        """Prefix sums for hashes of word sequences."""
        return prefix_hash(hash_ranges(self.data, self.start, self.end, base), base)

    def windows(self, length: int) -> np.ndarray:
        """Flags of words at which a window of `length` words of one document starts."""
        last = self.first[1:][self.doc]
        return np.arange(len(self.doc)) + length <= last


def sliding(op, x: np.ndarray, width: int, fill) -> np.ndarray:
    """op over x[i : i + width], places beyond the end counting as `fill`."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full(len(out), fill, out.dtype)
        moved[: max(len(out) - step, 0)] = out[step:]
        out = op(out, moved)
        have += step
    return out


def chosen(part: np.ndarray, full: np.ndarray, inside: int) -> np.ndarray:
    """Flags of the parts that are least among the `inside` parts of some full window (flags of their starts)."""
    top = np.uint64(2**64 - 1)
    least = np.where(full, sliding(np.minimum, part, inside, top), np.uint64(0))
    # part i is chosen if the greatest of the minima of the windows that hold it is its own hash
    back = sliding(np.maximum, least[::-1], inside, np.uint64(0))[::-1]
    return (back == part) & (back > 0)


def _level(w: Words, c: np.ndarray, part: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `part` words, flags of the chosen ones, flags of full windows."""
    n = len(w.doc)
    i = np.arange(n)
    h = np.maximum(mix(range_hash(c, i, np.minimum(i + part, n)) * np.uint64(2 * part + 1)), np.uint64(1))
    full = w.windows(window)
    return h, chosen(h, full, window - part + 1), full


def _survivors(w: Words, c: np.ndarray, part: int, window: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of full windows whose own least part is flagged as repeated (parts chosen by other windows say nothing: those reach beyond it)."""
    h, _, full = _level(w, c, part, window)
    top = np.uint64(2**64 - 1)
    inside = window - part + 1
    return full & (sliding(np.minimum, np.where(repeated, h, top), inside, top) == sliding(np.minimum, h, inside, top))


def repeated_starts(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """Replies (home, payload) that name each window start whose word sequence also starts earlier, and the number of homes; rows: as `rows_of` makes them."""
    spark = rows.sparkSession
    homes, reducers = extent(rows)
    levels = [p for p in (window // 4, window // 2) if p > 1] or [window]

    def ask(w: Words, table, key: np.ndarray, check: np.ndarray | None, at: np.ndarray, first: bool) -> pa.RecordBatch:
        row = w.doc[at]
        return entries(key, check, row, at - w.first[row], column_of(table, "ident"), column_of(table, "doc_id"), reducers, homes, first)

    def begin(part: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_bytes(part.column("text")))
        h, picks, _ = _level(w, w.hash(), levels[0], window)
        at = np.flatnonzero(picks)
        return ask(w, part, h[at], None, at, False)

    told = materialize(answer(per_slice(rows, begin, PACKED, ("doc_id", "text", "ident")), homes))
    for part, longer in zip(levels, [*levels[1:], window]):

        def extend(left: pa.Table, right: list[bytes], part=part, longer=longer) -> pa.Table:
            w, idents = Words(*text_bytes(left.column("text"))), column_of(left, "ident")
            c = w.hash()
            ident, pos, _ = replies(right)
            full = _survivors(w, c, part, window, marks(idents, w.first[:-1], ident, pos, len(w.doc)))
            at = np.flatnonzero(full)
            if longer == window:
                out = ask(w, left, mix(range_hash(c, at, at + window)), check_bits(w.hash(SECOND_BASE), at, at + window), at, True)
            else:
                h, picks, _ = _level(w, c, longer, window)
                at = np.flatnonzero(picks & (cover(at, window - longer + 1, len(full)) if len(full) else full))
                out = ask(w, left, h[at], None, at, False)
            return pa.Table.from_batches([out])

        told = materialize(answer(at_homes(rows, told, homes, extend, PACKED), homes, first=longer == window))
        release_shuffles(spark)
    return told, homes


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _finish(table: pa.Table | pa.RecordBatch, told: list[bytes], window: int, digest: bool) -> list[pa.Array]:
    w = Words(*text_bytes(table.column("text")))
    ident, pos, _ = replies(told)
    start = np.flatnonzero(marks(column_of(table, "ident"), w.first[:-1], ident, pos, len(w.doc)))
    kept = ~cover(start, window, len(w.doc)) if len(w.doc) else np.zeros(0, bool)
    raw = w.data.tobytes()
    texts = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        own = np.flatnonzero(kept[a:b]) + a
        texts.append(b" ".join([raw[s:e] for s, e in zip(w.start[own].tolist(), w.end[own].tolist())]))
    removed = np.concatenate(([0], np.cumsum(~kept)))
    out = pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts], pa.string())
    col = table.column("doc_id")
    return [col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, pa.array(w.count.astype(np.int64)), pa.array((removed[w.first[1:]] - removed[w.first[:-1]]).astype(np.int64)), out]


def window_dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words joined by one space (`kept`; with `digest` their SHA-256, `kept_sha256`).

    A word goes if a window of `window` words over it also starts earlier: in a row with a smaller doc_id, or further ahead
    in the same row.  A null doc_id is the smallest.  Rows that share a doc_id (or have none) are neither earlier nor later
    than each other, so repeated rows lose nothing to their copies.  Null, empty and shorter texts lose nothing.  An empty
    table gives no rows; other columns of `docs`, whatever their names, are not read.  A text is held whole by one worker.
    """
    rows = rows_of(docs)
    room = F.octet_length("text") >= 2 * window - 1
    some, rest = rows.filter(room), rows.filter(~F.coalesce(room, F.lit(False)))  # texts without room for a window don't travel
    told, homes = repeated_starts(some, window)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    out = at_homes(some, told, homes, lambda left, right: pa.table(_finish(left, right, window, digest), schema=_OUT), schema)
    out = out.unionByName(per_slice(rest, lambda part: pa.RecordBatch.from_arrays(_finish(part, [], window, digest), schema=_OUT), schema, ("doc_id", "text", "ident")))
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`window_dedup` of every whole text of `documents`, kept words as digests."""
    return window_dedup(documents(spark, sf_dir), digest=True)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
