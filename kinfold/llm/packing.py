"""Best-fit packing by minimum bin slack (operator 3).

Texts become token ids closed by id 0; only texts longer than the capacity are cut.  Packing needs nothing but how many
pieces there are of each length, a table with at most `capacity` rows however large the corpus is.  On that table the
driver repeats: the longest piece left opens a sequence, a bitset subset-sum over the lengths still available finds the
fullest feasible filling, and the combination is removed as many times as the counts allow.  Pieces are then numbered
within their length (salted, so that a length that holds a third of all pieces is spread over tasks) and the number
looks up its sequence and offset.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.byte_bpe import byte_characters
from kinfold.llm.common import documents, materialize, per_slice

CAPACITY = 2048
#: Pieces of one length that are numbered in one task, on average.
PER_SALT = 20_000
#: Distinct chunks, and distinct words, that a worker remembers before it starts afresh.
CACHE = 400_000

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: The tokenizer's own split, written out for texts below U+0180 (all of which are in NFC).
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
WIDE = re.compile("[^\\0-\\x1b\\x20-\\u017f]")


class WordBPE:
    """The tokenizers library's ids of whole texts, with each distinct word encoded once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: Texts that may hold an added token, in any case, are left to the library whole.
        self.special = re.compile("|".join(re.escape(t) for t in added), re.I) if added else None
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([])
        self.table = dict(enumerate(byte_characters()))
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in words]
        e = self.words.encode(mapped, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(words)), "right").tolist()
        self.cache.update(zip(words, [ids[4 * s : 4 * t] for s, t in zip([0, *ends], ends)]))

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if WIDE.search(text) or (self.special and self.special.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.lower().split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            new = list(dict.fromkeys([c for c, f in zip(chunks, found) if f is None]))
            if len(self.chunks) + len(new) > CACHE:
                self.chunks.clear()
            split = list(map(WORDS.findall, new))
            missing = list(dict.fromkeys([w for ws in split for w in ws if w not in self.cache]))
            if len(missing) > CACHE // 2:  # one text with more words than are remembered
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if missing:
                if len(self.cache) + len(missing) > CACHE:
                    self.cache.clear()
                    missing = list(dict.fromkeys([w for ws in split for w in ws]))
                self._learn(missing)
            get = self.cache.__getitem__
            known = {c: b"".join(map(get, ws)) for c, ws in zip(new, split)}
            self.chunks.update(known)
            found = [f if f is not None else known[c] for c, f in zip(chunks, found)]
        return b"".join(found)


@lru_cache(2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A null or empty text has one piece, the closing 0.  Repeated rows, and rows without a doc_id, have pieces of their own.
    An empty table has none; other columns, whatever their names, are not read.  A text is held whole by one worker.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tok = tokenizer(path)
        cols: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        ids = []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            packed = tok.encode_packed(text or "") + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                own = packed[at : at + 4 * capacity]
                for c, v in zip(cols, (doc, k, at // 4, len(own) // 4, zlib.crc32(own))):
                    cols[c].append(v)
                if with_ids:
                    ids.append(np.frombuffer(own, "<u4").astype(np.int64))
        arrays = [pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in cols.items()]
        names = list(cols)
        if with_ids:
            arrays.append(pa.array(ids, pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return per_slice(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, PIECES + (", ids array<long>" if with_ids else ""))


def fullest(room: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """Copies of each length whose sum is as near to `room` as possible, never above.  available: lengths, longest first, and counts."""
    goal, reach, layers = 1 << room, 1, []
    mask = (goal << 1) - 1
    for length, count in available:
        if length > room:
            continue
        left, k = min(count, room // length), 1
        while left:
            take = min(k, left)
            layers.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
            if reach & goal:
                left = 0
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def minimum_bin_slack(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and how many sequences hold each."""
    left = dict(sorted(((k, v) for k, v in counts.items() if v), reverse=True))
    plan = []
    while left:
        longest = next(iter(left))
        combination = {longest: 1}
        rest = [(k, v - (k == longest)) for k, v in left.items()]
        for k, v in fullest(capacity - longest, [x for x in rest if x[1]]).items():
            combination[k] = combination.get(k, 0) + v
        times = min(left[k] // v for k, v in combination.items())
        plan.append((combination, times))
        for k, v in combination.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each (combination, length): numbers within the length from `first` on go round the sequences from `sequence` on, `copies` in each, from `offset` on."""
    rows, used, sequence = [], {}, 0
    for combination, times in plan:
        offset = 0
        for length, copies in combination.items():
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "copies", "sequence", "offset"), table.T))


def numbered(table: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """`table` with `number`, 0, 1, 2... within each value of `group`; a value's rows are salted over tasks."""
    salts = max(1, -(-rows // PER_SALT))
    salted = table.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(group, "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("salt")) - F.col("n")).drop("n")
    own = salted.withColumn("own", F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order)) - 1)
    return own.join(before, [group, "salt"]).withColumn("number", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places pieces (doc_id, piece, length and any other columns) in sequences: adds sequence_id and offset.

    Lengths are 1 to `capacity`.  Ties and repeated rows are pieces of their own.  `table` is read twice and should be a
    written table.  An empty table stays empty.
    """
    counts = {int(r["length"]): int(r["n"]) for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = slots(minimum_bin_slack(counts, capacity))
    starts = where["length"] * (1 << 44) + where["first"]
    columns = [c for c in table.columns if c not in ("sequence_id", "offset")]

    def place(batches):
        for b in batches:
            length, number = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            row = np.searchsorted(starts, length * (1 << 44) + number, "right") - 1
            k = number - where["first"][row]
            copies = where["copies"][row]
            sequence = where["sequence"][row] + k // copies
            offset = where["offset"][row] + (k % copies) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in columns), "sequence_id long, offset long"])
    out = numbered(table.select(*columns), "length", ["doc_id", "piece"], sum(counts.values()))
    return out.select(*columns, "number").mapInArrow(place, schema)


def assemble(placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from placed pieces that carry their ids (a sequence holds at most `capacity` ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut, tokenize and place whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack(materialize(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity)), capacity)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack_documents` of every whole text of `documents`."""
    return pack_documents(documents(spark, sf_dir))
