"""Line dedup by a deletion-neighbourhood join (operator 4).

Lines are compared trimmed of ASCII white space and with A-Z lower-cased.  A line goes if an earlier line (of a row with a
smaller doc_id, or further ahead in the same row) is equal or within one edit.  Equal lines are first folded into one
class by a 128-bit hash.  Of different lines, two within one edit agree on a whole half at one end, so only classes that
share a half with another one enter the join proper: they emit a hashed key for every variant with one character deleted,
and themselves.  Equal keys meet: the same deletion at the same place is a substitution, a line that equals another's
variant is an insertion or deletion.  Pairs are verified by edit distance on the lines themselves.  What travels back is
one place for each class, its earliest, so that a line that fills the corpus is never joined with its occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import BASE, NULL_DOC, PACKED, PACKED_SCHEMA, SECOND_BASE, blobs_by, column_of, documents, ident_of, materialize, mix, per_slice, prefix_hash, range_hash, release_shuffles, rows_of

#: Shorter lines (in characters) are never removed; below FUZZY, where one edit often makes another fact, they are compared for equality only.
SHORTEST = 10
FUZZY = 20
#: Stands for the place of the deleted character in a line's own key.
SELF = 2**32 - 1
#: Characters of text, and variants, that a worker turns into keys at a time.
BLOCK = 1 << 18


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, A-Z lower-cased, and where each text begins and ends."""
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((x >= 65) & (x <= 90), x + 32, x), off


def line_ranges(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, number in the document, trimmed start and end of each line."""
    breaks = np.flatnonzero(x == 10)
    begin = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
    doc = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1))
    doc = np.sort(doc, kind="stable")
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    number = np.arange(len(doc)) - first[doc]
    end = np.append(begin[1:], off[-1])
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, off[doc + 1], end - 1)
    blank = ((x >= 9) & (x <= 13)) | (x == 32)
    solid = np.flatnonzero(~blank)
    lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = hi > lo
    s, e = begin.copy(), begin.copy()
    s[some], e[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    return doc, number, s, e


_LINES = pa.schema([("doc", pa.int64()), ("ident", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _values(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) + np.uint64(1))


def _blocks(texts: list[str]) -> list[tuple[int, int, str]]:
    """(row, number of the first line, text) for parts of about BLOCK characters that end with a line."""
    out = []
    for row, t in enumerate(texts):
        at, line = 0, 0
        while len(t) - at > BLOCK and (cut := t.find("\n", at + BLOCK)) >= 0:
            out.append((row, line, t[at:cut]))
            line += t.count("\n", at, cut) + 1
            at = cut + 1
        out.append((row, line, t[at:] if at else t))
    return out


def _lines(shortest: int, fuzzy: int):
    def some(parts: list[tuple[int, int, str]], docs: np.ndarray, idents: np.ndarray) -> pa.RecordBatch:
        x, off = code_points([t for _, _, t in parts])
        part, number, s, e = line_ranges(x, off)
        keep = np.flatnonzero(e - s >= max(shortest, 1))
        part, number, s, e = part[keep], number[keep], s[keep], e[keep]
        v = _values(x)
        c = prefix_hash(v)
        n = e - s
        h1, h2 = mix(range_hash(c, s, e)), mix(range_hash(prefix_hash(v, SECOND_BASE), s, e, SECOND_BASE))
        keys = []
        for half in (n // 2, (n - 1) // 2):
            size = mix(half.astype(np.uint64))
            keys += [mix(range_hash(c, s, s + half) ^ size), mix(range_hash(c, e - half, e) + size)]
        keys = np.stack(keys, axis=1).view(np.int64)
        count = np.where(n < fuzzy, 0, np.where(n % 2 == 1, 2, 4))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(keys[np.arange(4) < count[:, None]], pa.int64()))
        rows, before = (np.array([p[k] for p in parts], np.int64)[part] for k in (0, 1))
        arrays = [pa.array(docs[rows]), pa.array(idents[rows]), pa.array((number + before).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists]
        return pa.RecordBatch.from_arrays(arrays, schema=_LINES)

    def work(batch: pa.RecordBatch):
        docs, idents = column_of(batch, "doc_id"), column_of(batch, "ident")
        held: list = []
        for part in _blocks([t or "" for t in batch.column("text").to_pylist()]):
            held.append(part)
            if sum(len(p[2]) for p in held[-2:]) > BLOCK or len(held) >= 1024:
                yield some(held, docs, idents)
                held = []
        if held:
            yield some(held, docs, idents)

    return work


def _chosen_lines(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, doc, ident, line, norm (normalised text) of the lines named in `chosen` (node, doc, ident, line)."""
    lists = chosen.groupBy("ident").agg(F.collect_list(F.struct("line", "node")).alias("lines"))  # no longer than the document
    own = rows.dropDuplicates(["ident"]).join(lists.hint("merge"), "ident").select("doc_id", "ident", "text", "lines")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int, str]] = []
        for doc, ident, text, lines in zip(column_of(part, "doc_id").tolist(), *(part.column(c).to_pylist() for c in ("ident", "text", "lines"))):
            all_lines = text.split("\n")
            out += [(x["node"], doc, ident, x["line"], all_lines[x["line"]].strip(SPACE).translate(LOWER)) for x in lines]
        cols = list(zip(*out)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["node", "doc", "ident", "line", "norm"])

    return per_slice(own, work, "node long, doc long, ident long, line int, norm string", ("doc_id", "ident", "text", "lines"), lean=True)


LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\r\x0b\x0c"
_BACK = np.uint64(pow(BASE, -1, 1 << 64))


def variants(text: str):
    """Keys of a line's variants with one character deleted, with the place of it, and of the line itself (place SELF), in blocks."""
    n, carry, scale = len(text), 0, 1
    ends = []
    for at in range(0, n, BLOCK):  # prefix sums at the ends of blocks, the last being the whole line's
        v = _values(np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4"))
        ends.append((carry, scale))
        carry = (carry + scale * int(prefix_hash(v)[-1])) % 2**64
        scale = scale * pow(BASE, len(v), 1 << 64) % 2**64
    size = np.uint64((n - 1) * BASE % 2**64)
    for at, (before, scale) in zip(range(0, n, BLOCK), ends):
        v = _values(np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4"))
        c = prefix_hash(v) * np.uint64(scale) + np.uint64(before)
        yield mix(c[:-1] + (np.uint64(carry) - c[1:]) * _BACK + size), np.arange(at, at + len(v), dtype=np.uint32)
    yield mix(np.array([(carry + n * BASE) % 2**64], np.uint64)), np.array([SELF], np.uint32)


def _packed(reducers: int):
    def some(v: list, i: list, node: list) -> pa.RecordBatch:
        v, i, node = np.concatenate(v), np.concatenate(i), np.concatenate(node)
        make = lambda k: len(k).to_bytes(4, "little") + v[k].tobytes() + i[k].tobytes() + node[k].tobytes()
        return blobs_by(((v & np.uint64(0xFFFFFFFF)) % np.uint64(reducers)).astype(np.int64), make, PACKED_SCHEMA)

    def work(part: pa.RecordBatch):
        v, i, node, held = [], [], [], 0
        for t, who in zip(part.column("text").to_pylist(), part.column("node").to_pylist()):
            for a, b in variants(t):
                v.append(a)
                i.append(b)
                node.append(np.full(len(a), who, np.int64))
                held += len(a)
                if held >= 4 * BLOCK:
                    yield some(v, i, node)
                    v, i, node, held = [], [], [], 0
        if held:
            yield some(v, i, node)

    return work


def _meet(table: pa.Table) -> pa.Table:
    """v, i, node of the variants that agree with another line's: same deletion at the same place i, or a line (i is SELF) and one deletion each from others that equal it (-1 - i)."""
    parts = []
    for b in table.column("payload").to_pylist():
        n = int.from_bytes(b[:4], "little")
        parts.append((np.frombuffer(b, "<u8", n, 4), np.frombuffer(b, "<u4", n, 4 + 8 * n), np.frombuffer(b, "<i8", n, 4 + 12 * n)))
    v, i, node = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(v, kind="stable")
    again = v[order][1:] == v[order][:-1]
    order = order[np.append(again, False) | np.append(False, again)]  # keys that occur once are done
    v, i, node = v[order], i[order], node[order]
    order = np.lexsort((node, i, v))
    v, i, node = v[order], i[order], node[order]
    same = (v[1:] == v[:-1]) & (i[1:] == i[:-1])
    sub = np.append(same, False) | np.append(False, same)
    own = i == SELF
    less = np.flatnonzero(np.isin(v, v[own]) & ~own)  # a run of one character has the same variant at each of its places
    less = less[np.lexsort((node[less], v[less]))]
    less = less[np.append(True, (v[less][1:] != v[less][:-1]) | (node[less][1:] != node[less][:-1]))[: len(less)]]
    whole = np.flatnonzero(own & np.isin(v, v[less]))
    at = np.concatenate((np.flatnonzero(sub & ~own), less, whole))
    place = np.concatenate((i[sub & ~own].astype(np.int64), -1 - i[less].astype(np.int64), np.full(len(whole), SELF)))
    return pa.table([pa.array(v[at].view(np.int64)), pa.array(place), pa.array(node[at])], names=["v", "i", "node"])


def _near_pairs(met: DataFrame, texts: DataFrame, odd: DataFrame | None) -> DataFrame:
    """Verified pairs of classes, x_* and y_* (node, doc, ident, line): of a substitution group each class with the earliest, and every insertion."""
    order = ["doc", "ident", "line", "node", "norm"]
    members = met.distinct().join(texts, "node").select("v", "i", F.struct(*order).alias("at"))
    sub = members.filter((F.col("i") >= 0) & (F.col("i") != SELF)).withColumn("least", F.min("at").over(Window.partitionBy("v", "i")))  # a group has no more members than there are characters
    pairs = sub.filter("at <> least").select("i", F.col("at").alias("x"), F.col("least").alias("y"))
    if odd is not None:  # rows that share a doc_id are compared row by row: all pairs of such a group
        tied = sub.filter("at.doc = least.doc").select("v", "i", "at").join(odd, F.col("at.doc") == F.col("odd"), "left_semi")
        pairs = pairs.unionByName(tied.select("v", "i", F.col("at").alias("x")).join(tied.select("v", "i", F.col("at").alias("y")), ["v", "i"]).filter("x < y").select("i", "x", "y"))
    whole, less = members.filter(F.col("i") == SELF).select("v", F.col("at").alias("y")), members.filter("i < 0").select("v", (-1 - F.col("i")).alias("i"), F.col("at").alias("x"))
    # edit distance 1: both lines without the character at that place, or one without it and the other, are the same
    without = lambda t: F.expr(f"concat(left({t}.norm, int(i)), substring({t}.norm, int(i) + 2))")
    near = pairs.filter(without("x") == without("y")).drop("i").unionByName(less.join(whole, "v").filter(without("x") == F.col("y.norm")).select("x", "y"))
    return near.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in order[:-1])).distinct()


def kept_places(rows: DataFrame, shortest: int = SHORTEST, fuzzy: int = FUZZY) -> DataFrame:
    """ident, line (from 0) of the lines of at least `shortest` characters that stay; rows: as `rows_of` makes them."""
    spark = rows.sparkSession
    lines = per_slice(rows, _lines(shortest, fuzzy), "doc long, ident long, line int, n int, h1 long, h2 long, keys array<long>", ("doc_id", "text", "ident"), lean=True)
    same = ["h1", "h2", "n"]
    classes = materialize(lines.groupBy(*same).agg(F.min(F.struct("doc", "ident", "line")).alias("at"), F.first("keys").alias("keys")).select(*same, "at.*", "keys"))
    # rows that share a doc_id without being alike; none where doc_id is a key
    odd = materialize(rows.select(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("odd"), "ident").groupBy("odd").agg(F.min("ident").alias("a"), F.max("ident").alias("b")).filter("a <> b").select("odd"))
    odd = None if odd.isEmpty() else odd
    place = ["h1", "doc", "ident", "line"]
    halves = classes.select(*place, F.explode(F.array_distinct("keys")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    chosen = materialize(halves.join(shared, "key", "left_semi").select(*place).distinct().withColumnRenamed("h1", "node"))
    texts = materialize(_chosen_lines(rows, chosen))
    chars = texts.agg(F.sum(F.length("norm"))).first()[0] or 0
    release_shuffles(spark)
    keys = per_slice(texts.select("node", F.col("norm").alias("text")), _packed(max(8, -(-chars // 500_000))), PACKED, ("node", "text"), lean=True)
    met = keys.groupBy("r").applyInArrow(_meet, "v long, i long, node long")
    near = materialize(_near_pairs(met, texts, odd))
    both = near.unionByName(near.select(*(F.col(("y" if c[0] == "x" else "x") + c[1:]).alias(c) for c in near.columns)))
    later = (F.col("x_doc") > F.col("y_doc")) | ((F.col("x_doc") == F.col("y_doc")) & (F.col("x_ident") == F.col("y_ident")) & (F.col("x_line") > F.col("y_line")))
    if odd is None:
        gone = both.filter(later).select(F.col("x_ident").alias("ident"), F.col("x_line").alias("line")).distinct()
        return classes.select("ident", "line").join(gone, ["ident", "line"], "left_anti")
    # every row that holds a class's smallest doc_id has a place of its own: its first line of that class
    own = lines.groupBy(*same, "doc", "ident").agg(F.min("line").alias("line")).join(odd, F.col("doc") == F.col("odd"), "left_semi")
    first = classes.select(*same, "doc", *(F.col(c).alias("first_" + c) for c in ("ident", "line")))
    seats = materialize(first.join(own, [*same, "doc"], "left").select("doc", "first_ident", "first_line", F.coalesce("ident", "first_ident").alias("ident"), F.coalesce("line", "first_line").alias("line")))
    seat = ["first_ident", "first_line"]
    gone = both.filter("x_doc > y_doc").select(F.col("x_ident").alias("first_ident"), F.col("x_line").alias("first_line")).distinct()
    left = materialize(seats.join(gone, seat, "left_anti"))
    tied = both.filter("x_doc = y_doc").select(F.col("x_ident").alias("first_ident"), F.col("x_line").alias("first_line"), "y_ident", "y_line")
    others = seats.select(F.col("first_ident").alias("y_ident"), F.col("first_line").alias("y_line"), "ident", F.col("line").alias("other"))
    behind = left.join(tied, seat).join(others, ["y_ident", "y_line", "ident"]).filter("other < line").select("ident", "line").distinct()
    return left.select("ident", "line").join(behind, ["ident", "line"], "left_anti").distinct()


def line_dedup(docs: DataFrame, shortest: int = SHORTEST, fuzzy: int = FUZZY) -> DataFrame:
    """`docs` with n_lines and n_removed (bigint), its text without the lines that are gone, the rest joined by line feeds.

    Lines are cut at line feeds only.  Lines of fewer than `shortest` characters, blank ones too, stay; those of fewer than
    `fuzzy` are compared for equality only (`fuzzy` 0 compares all).  A null doc_id counts as the smallest.  Rows that share
    a doc_id, or have none, are neither earlier nor later than each other, so that repeated rows keep what their copies
    keep.  A null text stays null and has no lines, an empty one has one line.  An empty table gives no rows.  Columns of
    `docs` keep their names and order; its own n_lines and n_removed are replaced.  A text is held whole by one worker.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    ident = ident_of(docs)
    kept = materialize(kept_places(rows_of(docs, ident), shortest, fuzzy)).groupBy("ident").agg(F.collect_list("line").alias("_kinfold_kept"))  # no longer than the document
    joined = docs.select(*names, ident.alias("_kinfold_ident")).join(kept.withColumnRenamed("ident", "_kinfold_ident").hint("merge"), "_kinfold_ident", "left")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, n, removed = [], [], []
        for text, stay in zip(part.column("text").to_pylist(), part.column("_kinfold_kept").to_pylist()):
            if text is None:
                texts.append(None)
                n.append(0)
                removed.append(0)
                continue
            own = set(stay or ())
            lines = text.split("\n")
            kept = [x for k, x in enumerate(lines) if k in own or len(x.strip(SPACE)) < max(shortest, 1)]
            texts.append("\n".join(kept) if len(kept) < len(lines) else text)
            n.append(len(lines))
            removed.append(len(lines) - len(kept))
        cols = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = ", ".join([*(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema if f.name in names), "n_lines long, n_removed long"])
    return per_slice(joined, work, schema, (*names, "_kinfold_kept"), lean=True)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`line_dedup` of every whole text of `documents`: doc_id, n_lines, n_removed and the digest of what stays (of nothing for a null text)."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
