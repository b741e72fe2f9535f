"""Repeated 200-byte strings by prefix-free parsing (operator 6).

A rolling hash over TRIGGER bytes ends a phrase wherever it is 0 modulo MODULUS; a phrase runs from the start of one
trigger to the end of the next, so no phrase is a prefix of another and equal text is parsed alike.  The corpus becomes a
dictionary of distinct phrases and a parse.  Suffixes that start in a phrase are ordered by that phrase's own bytes and
then by the parse that follows, so a string can only repeat if the whole phrases within it do, and everything that
starts in a phrase repeats if the phrase and what follows it do:

1. phrases, and phrases with what follows them (the `span` of all strings that start in one), are hashed and grouped over
   the corpus;
2. strings in repeated spans are settled; strings that hold a phrase found once are settled too; the rest (the seams
   between repeated and other text) are hashed one by one and grouped, together with one copy of each repeated span,
   first by 48 bits of their hashes and then, where those agree, by 80;
3. the flagged starts mark the bytes to remove.

Nothing is ordered in one place: hashes go to reducers in packed form, one from each slice for each distinct string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import PACKED, REPLY_SCHEMA, SECOND_BASE, answer, at_homes, byte_hash, check_bits, column_of, cover, documents, entries, extent, homes_of, marks, materialize, mix, pack, per_slice, range_hash, release_shuffles, replies, rows_of, text_bytes

LENGTH = 200
TRIGGER = 8
MODULUS = 32


class Parse:
    """Phrases of consecutive documents: p is where a phrase starts (its first trigger), q where it ends."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.c = byte_hash(data)
        n = len(data)
        if n > TRIGGER:
            i = np.arange(n - TRIGGER + 1)
            fire = np.flatnonzero(mix(range_hash(self.c, i, i + TRIGGER)) % np.uint64(MODULUS) == 0)
            doc = np.searchsorted(off, fire, "right") - 1
            inside = fire + TRIGGER <= off[doc + 1]
            fire, doc = fire[inside], doc[inside]
            pairs = np.flatnonzero(doc[1:] == doc[:-1])
            self.p, self.q, self.doc = fire[pairs], fire[pairs + 1] + TRIGGER, doc[pairs]
            self.next = fire[pairs + 1]
        else:
            self.p = self.q = self.next = self.doc = np.zeros(0, np.int64)

    def starts(self, length: int) -> np.ndarray:
        """Flags of the places where a string of `length` bytes of one document starts."""
        left = np.repeat(self.off[1:], np.diff(self.off)) - np.arange(len(self.data))
        return left >= length


#: Set in the place of an entry that asks for a span.
SPAN = np.uint32(1 << 31)
_SALT = np.uint64(0x5851F42D4C957F2D)


def _asked(parse: Parse, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the phrases no longer than `length`, and of those whose span ends in the document."""
    return np.flatnonzero(parse.q - parse.p <= length), np.flatnonzero(parse.next - 1 + length <= parse.off[parse.doc + 1])


def _sorted_out(parse: Parse, idents: np.ndarray, told: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of starts that are settled as repeated, of those still open, and of one copy of each repeated span."""
    ident, pos, tag = replies(told)
    n = len(parse.data)
    is_span = pos >= SPAN
    at = pos & (SPAN - np.uint32(1))
    first = parse.off[:-1]
    repeated = marks(idents, first, ident[~is_span], at[~is_span], n)
    spans = marks(idents, first, ident[is_span], at[is_span], n)
    copies = marks(idents, first, ident[is_span & (tag == 1)], at[is_span & (tag == 1)], n)
    starts = parse.starts(length)

    def fill(which: np.ndarray) -> np.ndarray:
        own = which[parse.p]
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, parse.p[own], 1)
        np.add.at(step, parse.next[own], -1)
        return (np.cumsum(step[:-1]) > 0) & starts

    settled = fill(spans)
    once = ~repeated[parse.p] & (parse.q - parse.p <= length)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(parse.q[once] - length, first[parse.doc[once]]), 1)
    np.add.at(step, parse.p[once] + 1, -1)
    still = starts & ~settled & ~(np.cumsum(step[:-1]) > 0)
    return settled, still, fill(copies) & settled


def repeated_strings(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, int]:
    """Replies (home, payload) for each home: what pass 1 and pass 2 found, pass 2's with a tag of 2; and the number of homes."""
    spark = rows.sparkSession
    homes, reducers = extent(rows)

    def begin(part: pa.RecordBatch) -> list[pa.RecordBatch]:
        data, off = text_bytes(part.column("text"))
        parse, ident, doc = Parse(data, off), column_of(part, "ident"), column_of(part, "doc_id")
        whole, spans = _asked(parse, length)
        place = (parse.p - parse.off[parse.doc]).astype(np.uint32)
        a, e = parse.p[spans], parse.next[spans] - 1 + length
        phrases = entries(mix(range_hash(parse.c, parse.p[whole], parse.q[whole])), None, parse.doc[whole], place[whole], ident, doc, reducers, homes)
        follows = entries(mix(range_hash(parse.c, a, e) ^ _SALT), check_bits(byte_hash(data, SECOND_BASE), a, e), parse.doc[spans], place[spans] | SPAN, ident, doc, reducers, homes, copies=True)
        return [phrases, follows]

    phrases = materialize(answer(per_slice(rows, begin, PACKED, ("doc_id", "text", "ident")), homes))
    release_shuffles(spark)

    def seams(left: pa.Table, right: list[bytes]) -> pa.Table:
        data, off = text_bytes(left.column("text"))
        parse, idents = Parse(data, off), column_of(left, "ident")
        _, still, copies = _sorted_out(parse, idents, right, length)
        i = np.flatnonzero(still | copies)
        home = homes_of(idents[:1], homes)
        return pa.Table.from_batches([entries(mix(range_hash(parse.c, i, i + length)), None, np.zeros(len(i), np.int64), i, home, home, reducers, None, known=copies[i])])

    likely = materialize(answer(at_homes(rows, phrases, homes, seams, PACKED), None))
    release_shuffles(spark)

    def confirm(left: pa.Table, right: list[bytes]) -> pa.Table:
        data, _ = text_bytes(left.column("text"))
        home = homes_of(column_of(left, "ident")[:1], homes)
        _, pos, tag = replies(right)
        order = np.argsort(pos)
        i, known = pos[order].astype(np.int64), tag[order] == 2
        key, check = mix(range_hash(byte_hash(data), i, i + length)), check_bits(byte_hash(data, SECOND_BASE), i, i + length)
        return pa.Table.from_batches([entries(key, check, np.zeros(len(i), np.int64), i, home, home, reducers, None, known=known)])

    # narrow keys of different strings may agree: the few places found are asked for once more with wide ones
    open_starts = materialize(answer(at_homes(rows, likely, homes, confirm, PACKED), None))
    release_shuffles(spark)

    def mark(batches):
        for b in batches:
            out = []
            for blob in b.column("payload").to_pylist():
                ident, pos, _ = replies([blob])  # places that were known before are repeated as well
                out.append(pack({"ident": ident}, {"pos": pos, "tag": np.full(len(pos), 2, np.uint8)}))
            yield pa.RecordBatch.from_arrays([b.column("home"), pa.array(out, pa.binary())], schema=REPLY_SCHEMA)

    return phrases.unionByName(open_starts.mapInArrow(mark, "home int, payload binary")), homes


def _removed(table: pa.Table | pa.RecordBatch, told: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = text_bytes(table.column("text"))
    first, second = [], []
    for b in told:
        (second if b[-1] == 2 else first).append(b)  # a blob ends with its last entry's tag
    settled, _, _ = _sorted_out(Parse(data, off), column_of(table, "ident"), first, length)
    for _, pos, _ in map(replies, ([b] for b in second)):
        settled[pos.astype(np.int64)] = True
    gone = cover(np.flatnonzero(settled), length, len(data)) if len(data) else np.zeros(0, bool)
    return data, off, gone


def _finish(table: pa.Table | pa.RecordBatch, told: list[bytes], length: int, digest: bool) -> list[pa.Array]:
    data, off, gone = _removed(table, told, length)
    total = np.concatenate(([0], np.cumsum(gone)))
    head = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
    head[off[:-1][off[:-1] < len(gone)]] = gone[off[:-1][off[:-1] < len(gone)]]
    heads = np.concatenate(([0], np.cumsum(head)))
    a, b = off[:-1], off[1:]
    kept = [data[s:e][~gone[s:e]].tobytes() if total[e] > total[s] else data[s:e].tobytes() for s, e in zip(a, b)]
    out = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary())
    col = table.column("doc_id")
    return [col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, *(pa.array(x.astype(np.int64)) for x in (b - a, total[b] - total[a], heads[b] - heads[a])), out]


def substring_dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and the remaining bytes (`kept`; with `digest` their SHA-256, `kept_sha256`).

    A byte goes if a `length`-byte string over it also starts anywhere else.  Matches never cross rows and are judged on the
    input.  Each row is a text of its own, whatever its doc_id: repeated rows, and rows that share a doc_id or have none,
    are copies of each other where they agree.  Null, empty and shorter texts lose nothing.  An empty table gives no rows;
    other columns of `docs`, whatever their names, are not read.  A text is held whole by one worker.
    """
    rows = rows_of(docs)
    room = F.octet_length("text") >= length
    some, rest = rows.filter(room), rows.filter(~F.coalesce(room, F.lit(False)))  # texts without room for a string don't travel
    told, homes = repeated_strings(some, length)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"
    out = at_homes(some, told, homes, lambda left, right: pa.table(_finish(left, right, length, digest), names=names), schema)
    out = out.unionByName(per_slice(rest, lambda part: pa.RecordBatch.from_arrays(_finish(part, [], length, digest), names=names), schema, ("doc_id", "text", "ident")))
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`substring_dedup` of every whole text of `documents`, remaining bytes as digests."""
    return substring_dedup(documents(spark, sf_dir), digest=True)
