"""Null and repeated doc_ids, ties, clashing columns: values against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import line_dedup, substring_dedup, window_dedup

FIELDS = "doc_id long, text string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


W, V = words(60, 1), words(60, 2)
FILLERS = [(10 + k, words(70, 100 + k)) for k in range(5)]
TABLES = {
    "copies": [(1, W), (1, W), (2, V)],
    "null before": [(None, W), (7, W)],
    "null among fillers": [*FILLERS, (None, W), (9, W)],
    "null with another text": [*FILLERS, (8, W), (9, W), (None, V)],
    "two nulls": [(None, W), (None, W), (None, V), (3, V)],
    "one id, two texts": [(4, W), (4, V), (5, W + " " + V), (4, V[5:])],
    "within": [(1, W + " " + W), (1, W + " " + W), (None, None), (None, ""), (2, " \t ")],
    "copies of many": [(k % 3, W) for k in range(30)] + [(None, W)] * 5,
}


def plain_windows(rows):
    low = -(2**63)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, tokens):
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, 2**63), low if d is None else d)
    out = Counter()
    for (d, _), w in zip(rows, tokens):
        seen, gone = set(), [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if first[k] < (low if d is None else d) or k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        out[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def plain_strings(rows):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = Counter()
    for (d, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[d, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    return out


@pytest.mark.parametrize("name", TABLES)
def test_windows_and_strings_of_odd_rows(spark, name):
    rows = TABLES[name]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], FIELDS + ", ident string, home int, kept int").repartition(3)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in window_dedup.window_dedup(df).collect()) == plain_windows(rows)
    got = substring_dedup.substring_dedup(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_strings(rows)


A, B, C = "the quick brown fox jumps over the dog", "a completely different line of text here", "third line, with nothing in common at all"
LINES = {
    "copies and a near line": [(1, A), (1, A), (2, A + "s\n" + B)],
    "one id, two texts": [(1, A + "\n" + B), (1, C + "\n" + A + "!\n" + A), (2, A + "\n" + C)],
    "nulls": [(None, A), (None, B), (None, A + "x\n" + A), (5, A + "\n" + B), (6, None), (None, None), (6, "")],
    "tied groups": [(3, "\n".join(A[:10] + c + A[11:] for c in "xyz")), (3, "\n".join(A[:10] + c + A[11:] for c in "yzw")), (4, A)],
    "long": [(1, "q" * 600_000 + A), (2, "q" * 600_000 + A[:-1]), (3, "\n".join([B] * 20_000))],
}


def plain_lines(rows):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b:
            return True
        if len(b) - len(a) > 1 or len(a) < line_dedup.FUZZY:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    low = -(2**63)
    first = {}
    own = [[x.strip(line_dedup.SPACE).translate(line_dedup.LOWER) for x in t.split("\n")] if t is not None else [] for _, t in rows]
    for (d, _), lines in zip(rows, own):
        for x in lines:
            first[x] = min(first.get(x, 2**63), low if d is None else d)
    out = Counter()
    for (d, t), lines in zip(rows, own):
        seen: set = set()
        kept = []
        for raw, x in zip((t or "").split("\n"), lines):
            if len(x) >= line_dedup.SHORTEST:
                gone = any(near(x, y) for y in seen) or any(near(x, y) for y, e in first.items() if e < (low if d is None else d) and len(y) >= line_dedup.SHORTEST)
                seen.add(x)
                if gone:
                    continue
            kept.append(raw)
        out[d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("name", LINES)
def test_lines_of_odd_rows(spark, name):
    rows = LINES[name]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'x' AS n_lines", "1 AS ident", "2 AS doc", "3 AS line").repartition(3)
    got = line_dedup.line_dedup(df).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == plain_lines(rows)


def test_pipeline_stages_of_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, ident string, words int, home int"
    texts = [(None, W), (None, V), (1, A), (1, A), (1, words(40, 9)), (2, None), (2, None), (3, ""), (4, W + " end"), (None, None), (5, "write to a.b@c.org now")]
    docs = spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), "x", 1, 2) for d, t in texts], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "pii", "packing"]
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, "/root/testdata/sf0.001")
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert stages[name](spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "near_dedup":  # W's group keeps the smallest doc_id that is one; wordless texts are a group; equal rows count once
            assert got == Counter([(None, V), (1, A), (1, words(40, 9)), (4, W + " end"), (2, None), texts[-1]])
        elif name == "line_dedup":  # without a doc_id comes first: W goes from nothing, as no line equals it
            assert got == Counter(texts)
        elif name == "pii":
            assert got == Counter([*texts[:-1], (5, "write to <EMAIL> now")])
    placed = stages["packing"](spark, docs, "")
    assert placed.count() == len(texts) and stages["packing"](spark, docs.limit(0), "").collect() == []
