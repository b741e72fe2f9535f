"""Byte-level BPE encoding and decoding with the tokenizers library (operator 7).

A rank file lists tokens as byte strings.  Every byte is written as a printable character (the byte-to-character map),
tokens become character strings, and each way to split a token into two smaller tokens becomes a merge of that token's
rank, so that the library's model repeats the rank-ordered merging.  Pre-tokens come from the public pattern; each
distinct pre-token is encoded once per worker and remembered in a bounded cache.  Where two merges of equal rank could
overlap, two orders of the merge list are compared and the rank rule itself decides if they differ.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import documents, per_slice

#: Distinct pre-tokens that a worker remembers before it starts afresh.
CACHE = 500_000
#: Characters up to which a pre-token is remembered.
SHORT = 64
#: Two merges of one rank can only overlap where a string is followed by itself and its own first character.
OVERLAP = re.compile(r"(.)(.*?)\1\2\1", re.S)
#: Letters, numbers and white space below U+0250, for the fast reading of the public pattern on such texts.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WIDE = re.compile("[^\0-\u024f]")


def byte_characters() -> list[str]:
    """The character of each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class ByteBPE:
    """Encode and decode by a rank file; ids, byte offsets and texts agree with rank-ordered merging of each pre-token."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.chars = byte_characters()
        self.bytes_of = {c: b for b, c in enumerate(self.chars)}
        self.pattern = regex.compile(pattern)
        self.latin = pattern == PATTERN
        table = self.chars
        name = {t: "".join([table[b] for b in t]) for t in self.ranks}
        vocab = {name[t]: r for t, r in self.ranks.items()}
        first: list[tuple[str, str]] = []
        last: list[tuple[str, str]] = []
        for t, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            ways = [(name[t[:i]], name[t[i:]]) for i in range(1, len(t)) if t[:i] in name and t[i:] in name]
            first += ways
            last += ways[::-1]
        make = lambda merges: Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.models = make(first), make(last)
        size = max(self.ranks.values()) + 1
        self.table = [b""] * size
        for t, r in vocab.items():  # reversed through the byte table, as a decoder has to
            self.table[r] = bytes([self.bytes_of[c] for c in t])
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.longest = int(self.lengths.max())
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.blob = np.frombuffer(b"".join(self.table), np.uint8)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The rank rule itself: join the leftmost pair of least rank until none is left; a heap of pairs over a linked list."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get(piece[start[i] : end[after[i]]]) if after[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if end[i] < 0 or after[i] >= n or end[after[i]] != to:
                continue  # one of the pair has been joined since
            gone = after[i]
            end[i], after[i], end[gone] = end[gone], after[gone], -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        return [self.ranks[piece[start[i] : end[i]]] for i in range(n) if end[i] >= 0]

    def doubtful(self, mapped: str) -> bool:
        """Whether two merges of one rank may overlap: a stretch of period L, no longer than a token, that is longer than 2 L."""
        if len(mapped) <= SHORT:
            return OVERLAP.search(mapped) is not None
        x = np.frombuffer(mapped.encode("utf-16-le"), "<u2")
        for period in range(1, min(self.longest, len(x) // 2) + 1):
            differ = np.flatnonzero(x[period:] != x[:-period])
            if (np.diff(differ, prepend=-1, append=len(x) - period) > period + 1).any():
                return True
        return False

    def _ids(self, model, mapped: list[str]) -> list[list[int]]:
        e = model.encode(mapped, is_pretokenized=True, add_special_tokens=False)
        ids, words = e.ids, np.array(e.word_ids, np.int64)
        ends = np.searchsorted(words, np.arange(len(mapped)), "right").tolist()
        return [ids[s:t] for s, t in zip([0, *ends], ends)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode distinct pre-tokens, and remember those of ordinary length."""
        if len(self.cache) + len(pieces) > CACHE:
            self.cache.clear()
        mapped = ["".join([self.chars[b] for b in p.encode()]) for p in pieces]
        found = self._ids(self.models[0], mapped)
        if doubtful := [i for i, m in enumerate(mapped) if self.doubtful(m)]:
            for i, ids in zip(doubtful, self._ids(self.models[1], [mapped[i] for i in doubtful])):
                if ids != found[i]:
                    found[i] = self.merge(pieces[i].encode())
        flat = np.array([i for ids in found for i in ids], "<u4").tobytes()
        at, out = 0, {}
        for p, ids in zip(pieces, found):
            out[p] = flat[at : at + 4 * len(ids)]
            at += 4 * len(ids)
        self.cache.update([(p, v) for p, v in out.items() if len(p) <= SHORT])
        return out

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (LATIN if self.latin and not WIDE.search(text) else self.pattern).findall(text)

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        pieces = self.split(text)
        for at in range(0, len(pieces), CACHE // 2):  # so many fit into the cache at once
            some = pieces[at : at + CACHE // 2]
            found = list(map(self.cache.get, some))
            if None in found:
                new = self._learn(list(dict.fromkeys([p for p, f in zip(some, found) if f is None])))
                found = [new[p] if f is None else f for p, f in zip(some, found)]
            out += found
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ids) else 0)].tobytes()

    def decode(self, ids) -> str:
        """Text of any ids; a character that the ids cut off becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids) -> Iterator[str]:
        """Text piece by piece; bytes of a character split over tokens wait until it is complete."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := decoder.decode(self.table[i]):
                yield s
        if s := decoder.decode(b"", True):
            yield s

    def offsets(self, ids) -> list[tuple[int, int]]:
        """Start and end of each token in the UTF-8 bytes of the text."""
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(self.table[i])))
            at += len(self.table[i])
        return out


@lru_cache(4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.uint32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of bigint) of every whole text; null is empty, empty gives an empty array, repeated rows repeat."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tok = tokenizer(path, pattern)
        ids = [np.frombuffer(tok.encode_packed(t or ""), "<u4").astype(np.int64) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return per_slice(docs, work, "doc_id long, ids array<long>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary): the bytes of the ids; a null array decodes to no bytes."""

    def run(batches):
        tok = tokenizer(path, pattern)
        for b in batches:
            out = [tok.decode_bytes(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids and digests both, in one pass over Arrow batches.

    Null and empty texts have no tokens and the digest of no bytes.  Repeated rows, and rows without a doc_id, each give a
    row.  An empty table gives none.  Other columns, whatever their names, are not read.  A text is held whole; the time
    for one pre-token grows as n log n, also for a text that is a single one.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tok = tokenizer(path, pattern)
        packed = [tok.encode_packed(t or "") for t in part.column("text").to_pylist()]
        ids = np.frombuffer(b"".join(packed), "<u4")
        ends = np.concatenate(([0], np.cumsum(tok.lengths[ids])))
        decoded = memoryview(tok.decode_bytes(ids))
        n = [len(p) // 4 for p in packed]
        cuts = ends[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))].tolist()
        a = [hashlib.sha256(p).hexdigest() for p in packed]
        b = [hashlib.sha256(decoded[s:e]).hexdigest() for s, e in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=_DIGEST)

    return per_slice(docs, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """`round_trip` of every whole text of `documents`."""
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
