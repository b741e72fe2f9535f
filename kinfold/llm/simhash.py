"""SimHash near-duplicates by deletion-variant signatures (operator 5).

A fingerprint is cut into so few segments (three, for four differing bits) that within any linked pair one segment
differs by one bit at most.  Each distinct fingerprint is indexed under every variant of every segment with one bit as a
wildcard, 64 keys in all; equal keys are joined and the full distance is verified in the join.  A key with more than
CROWD fingerprints (a large group of near copies) is not turned into pairs: it first links its members to its least one,
and components are formed; then crowded keys that still hold several components are joined, each member outside the
key's largest component against the others, which finds every link that could still merge two components.

`similar_texts` is the same method at another distance: texts that share four fifths of their five-word shingles differ in
some 6 to 15 of 100 bits, more than three segments of 64 bits can bridge.  Their fingerprints have 384 bits in 16 segments,
so that a segment can still differ by one bit at most, and links are verified on the sets of shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import documents, materialize, mix, per_slice, range_hash, rows_of, text_bytes
from kinfold.llm.components import components
from kinfold.llm.window_dedup import Words

WORDS = 4
SEED = 42
DISTANCE = 4
#: Fingerprints under one key from which its links are found by components rather than by pairs.
CROWD = 64


def fingerprint_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit majority of the hashes of each text; texts begin at `first`, texts without hashes give 0.

    Bits are counted eight at a time, one in each byte of a word, over runs of at most 255 hashes.
    """
    n = np.diff(np.append(first, len(hashes)))
    out = np.zeros(len(first), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    runs = -(-n[some] // 255)
    cuts = np.repeat(first[some], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    begin = np.cumsum(runs) - runs
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & ones, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        bits = (2 * counts > n[some][:, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of every shingle of the text's words (A-Z lower-cased, white space is ASCII), repeats included."""
    w = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [digest(b" ".join(w), SEED)] if w else []
    joined = b" ".join(w)
    starts, at = [], 0
    for n in map(len, w):
        starts.append(at)
        at += n + 1
    ends = [s - 1 for s in starts[words:]]
    ends.append(len(joined))
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends)]


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a bigint) of every whole text; null and wordless texts give 0."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes: list[int] = []
        first = []
        for text in part.column("text").to_pylist():
            first.append(len(hashes))
            if text:
                hashes += shingle_hashes(text.encode(), words)
        fp = fingerprint_hashes(np.array(hashes, np.uint64), np.array(first, np.int64))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(rows, work, "doc_id long, fp long")


def segments(distance: int) -> list[int]:
    """First bits of the fewest segments of which one differs by at most one bit: distance // segments <= 1."""
    n = distance // 2 + 1
    return [64 * i // n for i in range(n)]


def variants(table: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`table` with a row for each wildcard bit: `bit`, and `rest`, the other bits of that bit's segment of `fp`."""
    cuts = [*segments(distance), 64]
    mask = F.lit(0).cast("long")
    for a, b in zip(cuts, cuts[1:]):
        bits = ((1 << b) - 1) ^ ((1 << a) - 1)
        mask = F.when((F.col("bit") >= a) & (F.col("bit") < b), F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")).otherwise(mask)
    wild = F.expr("shiftleft(1L, bit)")
    return table.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("rest", F.col("fp").bitwiseAND(mask).bitwiseAND(F.bitwise_not(wild)))


def near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """node, root over the distinct fingerprints (column fp) that have links; reads `distinct` several times, so it should be a written table."""
    key = ["bit", "rest"]
    same = (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest"))
    keys = variants(distinct.select("fp"), distance).repartition(*key)
    crowds = materialize(keys.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*key))
    quiet = keys.join(crowds, key, "left_anti")
    pairs = quiet.alias("a").join(quiet.alias("b"), same & (F.col("a.fp") < F.col("b.fp")) & near("a.fp", "b.fp", distance)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = materialize(keys.join(crowds, key, "left_semi").select("fp", *key))
    least = crowded.groupBy(*key).agg(F.min("fp").alias("v"))
    star = crowded.alias("a").join(least.alias("b"), same & (F.col("a.fp") != F.col("b.v")) & near("a.fp", "b.v", distance)).select(F.col("a.fp").alias("u"), F.col("b.v").alias("v"))
    first = materialize(components(pairs.unionByName(star)))
    if crowded.isEmpty():
        return first
    named = materialize(crowded.join(first, F.col("fp") == F.col("node"), "left").select("fp", *key, F.coalesce("root", "fp").alias("part")))
    parts = named.groupBy(*key, "part").agg(F.count("*").alias("n"))
    mixed = parts.groupBy(*key).agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_keys = materialize(named.join(mixed, key))
    once = (F.col("b.part") == F.col("b.main")) | (F.col("a.part") < F.col("b.part"))
    across = open_keys.filter("part <> main").alias("a").join(open_keys.alias("b"), same & (F.col("a.part") != F.col("b.part")) & once & near("a.fp", "b.fp", distance)).select(F.col("a.part").alias("u"), F.col("b.part").alias("v")).distinct()
    second = materialize(components(across).withColumnsRenamed({"node": "old", "root": "new"}))
    return first.join(second, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(
        second.join(first, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of `docs`.

    Documents whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest doc_id
    reachable.  Wordless (also null) texts have fingerprint 0 and are linked like any other.  A null doc_id counts only if
    its component has no other (component_id is then null).  Repeated rows get the same answer.
    """
    fps = materialize(fingerprints(docs, words))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(distinct.join(linked(distinct, distance), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- similar texts: longer fingerprints, links verified on shingles -----------------------------------------------
SIMILARITY = 0.8
SHINGLE = 5
#: Words of a feature of the fingerprint: an edit changes fewer short features, so that fewer bits differ.
FEATURE = 2
SEGMENTS, BITS = 16, 24
SIG = [f"s{k}" for k in range(SEGMENTS * BITS // 64)]
#: Differing bits, of SEGMENTS * BITS, beyond which a pair isn't verified: texts of similarity 0.8 whose features differ as
#: much as their shingles have 58 on average, with a standard deviation of 7.
FAR = 96
#: Texts under one key from which its links are found by components rather than by pairs.
MANY = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_hashes(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    data, off = text_bytes(part.column("text"))
    w = Words(_LOWER[data], off)
    return w, w.hash()


def _shingles(w: Words, c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts (of fewer words: of the whole sequence, where there is a word), and where each text's begin."""
    n = np.where(w.count > size, w.count - size + 1, np.minimum(w.count, 1))
    first = np.cumsum(n) - n
    start = np.repeat(w.first[:-1], n) + np.arange(n.sum()) - np.repeat(first, n)
    return mix(range_hash(c, start, np.minimum(start + size, np.repeat(w.first[1:], n)))), first


def signatures(rows: DataFrame) -> DataFrame:
    """ident, doc_id, node (a hash of the text's words), words, and the SEGMENTS * BITS bits of its fingerprint as s0, s1, ... (0 for wordless texts); rows: as `rows_of` makes them."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        w, c = _word_hashes(part)
        h, first = _shingles(w, c, FEATURE)
        words = [fingerprint_hashes(mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)), first) for k in range(SEGMENTS * BITS // 64)]
        node = mix(range_hash(c, w.first[:-1], w.first[1:]) + w.count.astype(np.uint64)).view(np.int64)
        arrays = [part.column("ident"), part.column("doc_id"), pa.array(node), pa.array(w.count.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in words)]
        return pa.RecordBatch.from_arrays(arrays, names=["ident", "doc_id", "node", "words", *SIG])

    return per_slice(rows, work, "ident long, doc_id long, node long, words int, " + ", ".join(f"{c} long" for c in SIG), ("ident", "doc_id", "text"))


def close(a: str, b: str) -> Column:
    """Whether the fingerprints of two tables of an alias each differ in at most FAR bits."""
    differing = F.lit(0)
    for c in SIG:
        differing = differing + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return differing <= FAR


def segment_keys(texts: DataFrame) -> DataFrame:
    """node, key: one for every segment of the fingerprint and every bit of it as a wildcard."""
    bit = (np.uint64(1) << np.arange(BITS, dtype=np.uint64))[None, None]
    tag = (np.arange(SEGMENTS * BITS, dtype=np.uint64) << np.uint64(BITS)).reshape(1, SEGMENTS, BITS)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                words = np.stack([part.column(c).to_numpy() for c in SIG], axis=1).astype("<i8")
                sig = words.view(np.uint8).reshape(part.num_rows, SEGMENTS, BITS // 8).astype(np.uint64)
                own = (sig << (np.arange(BITS // 8, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64)[:, :, None]
                key = ((own & ~bit) | tag).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), SEGMENTS * BITS)), pa.array(key)], names=["node", "key"])

    return texts.select("node", *SIG).mapInArrow(run, "node long, key long")


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The rows of `pairs` (u, v and others; a written table) whose texts share `similarity` of their sets of shingles; texts: node and the ident of a row that has it."""

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        h, first = _shingles(*_word_hashes(part), SHINGLE)
        own = [np.unique(x).view(np.int64) for x in np.split(h, first[1:])]
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.list_(pa.int64()))], names=["node", "shingles"])

    asked = texts.select("node", "ident").join(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "node", "left_semi")
    own = materialize(per_slice(rows.join(asked, "ident").dropDuplicates(["node"]), sets, "node long, shingles array<long>", ("node", "text")))
    left, right = (own.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "uv")
    met = pairs.join(left, "u").join(right, "v").withColumn("both", F.size(F.array_intersect("su", "sv")))
    return met.filter(F.col("both") >= similarity * (F.size("su") + F.size("sv") - F.col("both"))).select(*pairs.columns)


def _similar_roots(texts: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """node, root over the nodes that have links."""
    keys = segment_keys(texts.filter("words > 0")).withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1")
    shared = materialize(keys)
    sigs = texts.select("node", *SIG)
    quiet, crowded = shared.filter(F.col("c") <= MANY).join(sigs, "node"), shared.filter(F.col("c") > MANY).drop("c")
    same = F.col("a.key") == F.col("b.key")
    named = lambda: (F.col("a.node").alias("u"), F.col("b.node").alias("v"))

    def near(found: DataFrame) -> DataFrame:  # few distinct pairs; a crowded key's rows don't carry fingerprints
        met = found.alias("p").join(sigs.alias("a"), F.col("p.u") == F.col("a.node")).join(sigs.alias("b"), F.col("p.v") == F.col("b.node"))
        return met.filter(close("a", "b")).select(*(F.col(f"p.{c}").alias(c) for c in found.columns))

    pairs = quiet.alias("a").join(quiet.alias("b"), same & (F.col("a.node") < F.col("b.node")) & close("a", "b")).select(*named())
    least = crowded.groupBy("key").agg(F.min("node").alias("v"))
    star = near(crowded.join(least, "key").filter("node <> v").select(F.col("node").alias("u"), "v").distinct())
    first = materialize(components(verified(materialize(pairs.unionByName(star).distinct()), texts, rows, similarity)))
    if crowded.isEmpty():
        return first
    # a crowded key of several components: its members outside its largest one against the others
    parted = materialize(crowded.join(first, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"))
    parts = parted.groupBy("key", "part").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_keys = materialize(parted.join(mixed, "key"))
    once = (F.col("b.part") == F.col("b.main")) | (F.col("a.part") < F.col("b.part"))
    across = open_keys.filter("part <> main").alias("a").join(open_keys.alias("b"), same & (F.col("a.part") != F.col("b.part")) & once)
    more = materialize(near(across.select(*named(), F.col("a.part").alias("pu"), F.col("b.part").alias("pv")).distinct()))
    second = materialize(components(verified(more, texts, rows, similarity).select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()).withColumnsRenamed({"node": "old", "root": "new"}))
    return first.join(second, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(
        second.join(first, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    )


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, ident, component_id, kept: one row per row of `docs`.

    Texts are linked whose sets of five-word shingles (A-Z lower-cased; of fewer words, the whole sequence) have at least
    this Jaccard similarity, and that share a segment of their fingerprints but for one bit.  component_id is the smallest
    doc_id reachable, null if all are null.  `ident` (see `rows_of`) names rows; `kept` marks the rows of one ident of each
    component, one with the smallest doc_id.  Wordless and null texts are one component.  Equal texts always are linked.
    An empty table gives no rows; other columns of `docs`, whatever their names, are not read.
    """
    rows = rows_of(docs)
    own = materialize(signatures(rows))
    texts = materialize(own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ident")).alias("least"), F.first("words").alias("words"), *(F.first(c).alias(c) for c in SIG)).select("node", "words", *SIG, "least", "least.ident"))
    roots = materialize(texts.select("node", "least").join(_similar_roots(texts, rows, similarity), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    return own.select("doc_id", "ident", "node").join(named, "node").select("doc_id", "ident", F.col("first.doc_id").alias("component_id"), (F.col("ident") == F.col("first.ident")).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` of every whole text of `documents`."""
    return near_duplicates(documents(spark, sf_dir))
