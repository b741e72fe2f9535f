"""Personal data by weak supervision (operator 9).

Base spans come from fixed rules.  Further candidates (obfuscated addresses, other digit groups, secrets) are judged by
labelers that vote yes, no or abstain: a strict pattern, a gazetteer of nearby words, the span's surroundings, and a
checksum.  Votes of all documents are counted by pattern (a table of bounded size), expectation-maximisation estimates
each labeler's reliability per kind, and a logistic span classifier is trained on the resulting soft labels over
discrete span features.  A second pass scores candidates and returns all spans; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import documents, per_slice

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: A candidate beside the base spans counts from this probability on.
THRESHOLD = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: The given rules with runs of digits read once (possessively); no shorter reading of a run can match where the whole one does not.
IP = re.compile(r"(?<![0-9])([0-9]++)(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

OBFUSCATED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,64})+\b")
DIGITS = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9])")

GAZETTEER = {
    "email": frozenset("mail email e-mail contact write address correo courriel kontakt".split()),
    "ip": frozenset("ip host server address addr gateway dns".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon handy téléphone teléfono".split()),
    "secret": frozenset("token key password secret passwd pwd apikey auth bearer".split()),
}
NEARBY = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ with its run of local characters before and a dotted domain after."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then by start."""
    out = [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in (m[1], m[2][1:], m[3][1:], m[4][1:]))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans beside the base ones that may hold personal data; none overlaps a base span or another."""
    found = []
    if "at" in text:
        found += [("email", m.start(), m.end()) for m in OBFUSCATED.finditer(text)]
    for m in DIGITS.finditer(text):
        n = len(digits_of(m[0]))
        found.append(("card" if n > 15 else "phone", m.start(), m.end()))
    for m in SECRET.finditer(text):
        if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append(("secret", m.start(), m.end()))
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[str, int, int]] = []
    last, k = 0, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= last and not (k < len(taken) and taken[k][0] < e):
            out.append((kind, s, e))
            last = e
    return out


ABSTAIN, NO, YES = 0, 1, 2
LABELERS = ("pattern", "gazetteer", "context", "checksum")


#: Where expectation-maximisation starts: how often a labeler votes yes on a true span, and on a false one.
START = {"pattern": (0.9, 0.1), "gazetteer": (0.9, 0.2), "context": (0.9, 0.6), "checksum": (0.95, 0.1)}
#: Votes that the start counts as, however many there are; a corpus outweighs it.
START_VOTES = 20.0


def _side(c: str) -> int:
    """0 edge or space, 1 letter, 2 digit, 3 quote or sign of assignment, 4 other mark."""
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\"'=:<>[]()" else 4


def votes(text: str, kind: str, s: int, e: int, is_base: bool) -> tuple[int, ...]:
    """What the labelers say of a span, and its discrete features."""
    span, before = text[s:e], text[max(0, s - 40) : s].lower()
    d = digits_of(span)
    left, right = _side(text[s - 1 : s] if s else ""), _side(text[e : e + 1])
    separators = sum(c in " ().-" for c in span)
    mixed = len(set(span)) >= 10
    if is_base:
        pattern = YES
    elif kind == "phone":
        pattern = YES if separators >= 2 and 9 <= len(d) <= 12 else NO
    elif kind == "secret":
        pattern = YES if len(span) >= 32 and len(d) >= 4 else NO
    else:
        pattern = ABSTAIN
    gazetteer = YES if GAZETTEER[kind] & set(NEARBY.findall(before)[-4:]) else ABSTAIN
    context = NO if left in (1, 2) or right in (1, 2) else YES if left in (0, 3) else ABSTAIN
    if kind == "card":
        checksum = YES if luhn(d) else NO
    elif kind == "phone":
        checksum = YES if 9 <= len(d) <= 15 and len(set(d)) > 2 else NO
    elif kind == "secret":
        checksum = YES if mixed else NO
    else:
        checksum = ABSTAIN
    return KINDS.index(kind), pattern, gazetteer, context, checksum, left, right, min(len(span) // 8, 7), min(separators, 3)


#: Values that each place of a pattern can take: a pattern table has fewer rows than their product.
SIZES = (len(KINDS), 3, 3, 3, 3, 5, 5, 8, 4)


def pattern_counts(docs: DataFrame) -> DataFrame:
    """pattern (bigint), n: how often each combination of votes and features occurs over all whole texts."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in part.column("text").to_pylist():
            if text:
                base = base_spans(text)
                for k, s, e in base:
                    counts[votes(text, k, s, e, True)] += 1
                for k, s, e in candidates(text, base):
                    counts[votes(text, k, s, e, False)] += 1
        keys = [int(np.ravel_multi_index(v, SIZES)) for v in counts]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    return per_slice(docs, work, "pattern long, n long", ("text",)).groupBy("pattern").agg(F.sum("n").alias("n"))


def estimate(rows: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict[tuple[str, str], tuple[float, float]]]:
    """P(true) of each pattern, and by kind and labeler how often it votes yes on true and on false spans, by expectation-maximisation.

    Spans and labelers are all that it knows: a kind's share of true spans and each labeler's two rates start from START and
    are then re-estimated from all votes.  An abstention says nothing.
    """
    out, rates = np.full(len(rows), 0.5), {}
    for kind in range(len(KINDS)):
        own = rows[:, 0] == kind
        if not own.any():
            continue
        v, w = rows[own, 1:5], n[own].astype(float)
        yes, cast = v == YES, v != ABSTAIN
        hit, miss = (np.array([START[x][k] for x in LABELERS]) for k in (0, 1))
        prior = 0.5
        for _ in range(rounds):
            log = np.log(prior / (1 - prior)) + np.where(cast, np.where(yes, np.log(hit / miss), np.log((1 - hit) / (1 - miss))), 0).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            prior = np.clip((w @ p + START_VOTES / 2) / (w.sum() + START_VOTES), 1e-3, 1 - 1e-3)
            started = [np.array([START[x][k] for x in LABELERS]) * START_VOTES for k in (0, 1)]
            hit = ((w * p) @ (yes & cast) + started[0]) / ((w * p) @ cast + START_VOTES)
            miss = ((w * (1 - p)) @ (yes & cast) + started[1]) / ((w * (1 - p)) @ cast + START_VOTES)
            hit, miss = np.clip(hit, 1e-4, 1 - 1e-4), np.clip(miss, 1e-4, 1 - 1e-4)
        out[own] = p
        rates |= {(KINDS[kind], x): (float(a), float(b)) for x, a, b in zip(LABELERS, hit, miss)}
    return out, rates


def _features(rows: np.ndarray) -> np.ndarray:
    """Indicators of each vote and feature, together with the kind."""
    out = []
    for j in range(1, len(SIZES)):
        for k in range(len(KINDS)):
            out += [(rows[:, j] == x) & (rows[:, 0] == k) for x in range(SIZES[j])]
    return np.stack(out, axis=1).astype(float)


def train(counts: dict[int, int]) -> dict[int, float]:
    """The span classifier: a probability for every pattern, from a logistic model fitted to the labelers' joint opinion."""
    if not counts:
        return {}
    keys = np.array(sorted(counts), np.int64)
    rows = np.stack(np.unravel_index(keys, SIZES), axis=1)
    n = np.array([counts[int(k)] for k in keys], float)
    soft, _ = estimate(rows, n)
    x = _features(rows)
    w, g = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    weight = np.log1p(n) / np.log1p(n).sum()
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = x.T @ (weight * (p - soft)) + 1e-5 * w
        g += d * d
        w -= 0.3 * d / np.sqrt(g)
    return {int(k): float(v) for k, v in zip(keys, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))}


def fit(docs: DataFrame) -> dict[int, float]:
    """Counts votes over all of `docs` and trains; the table that reaches the driver has at most prod(SIZES) rows."""
    return train({int(r["pattern"]): int(r["n"]) for r in pattern_counts(docs).collect()})


def all_spans(text: str, model: dict[int, float]) -> list[tuple[str, int, int]]:
    """Base spans and accepted candidates, by kind as listed, then by start."""
    base = base_spans(text)
    more = [(k, s, e) for k, s, e in candidates(text, base) if model.get(int(np.ravel_multi_index(votes(text, k, s, e, False), SIZES)), 0.0) > THRESHOLD]
    return sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1])) if more else base


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


_SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of `docs`, whatever its doc_id.

    A null or empty text has no spans (and the digest of no bytes).  Spans of different kinds may overlap; added ones overlap
    nothing.  An empty table gives no rows; other columns, whatever their names, are not read.  A text is held whole by one
    worker.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in part.column("text").to_pylist():
            base = base_spans(text or "")
            n = Counter(k for k, _, _ in base)
            for c, v in zip(cols, (*(n[k] for k in BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(text or "", model)))):
                c.append(v)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(_SPANS)[1:]))], schema=_SPANS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(rows, work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets; other columns, null texts, and rows that repeat stay as they are."""
    names = docs.columns

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in part.column("text").to_pylist():
            last, parts = 0, []
            for k, s, e in sorted(all_spans(text or "", model), key=lambda x: (x[1], -x[2])):
                if s >= last:
                    parts += [text[last:s], f"<{k.upper()}>"]
                    last = e
                elif e > last:  # the rest of an overlapping span goes too
                    last = e
            out.append(text if text is None else "".join([*parts, text[last:]]))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else part.column(c) for c in names], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return per_slice(docs, work, schema, names)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find` in every whole text of `documents`, by a model fitted to the votes of all of them."""
    docs = documents(spark, sf_dir)
    return find(docs, fit(docs))
