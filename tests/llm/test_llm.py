"""Operators on training text against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import byte_bpe, exact_dedup, line_dedup, packing, pii, progressive_jpeg, quality_fm, simhash, substring_dedup, window_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
EDGES = [None, "", " \t\n", "a", "same text", "same text", "SAME text", "é", "日本語 🙂", "x" * 5000, LONG, LONG + " end", "\n\n\n", "tie\ntie\ntie"]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES, [*range(len(EDGES) - 2), None, 7]).withColumn("home", F.lit(1)).withColumn("score", F.lit("clash")).withColumn("gone", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


OPERATORS = {
    "media": lambda d: progressive_jpeg.digest(progressive_jpeg.store(d)),
    "score": lambda d: quality_fm.score(d, quality_fm.fit([], np.zeros(0))),
    "pack": packing.pack_documents,
    "lines": line_dedup.line_dedup,
    "near": simhash.near_duplicates,
    "strings": substring_dedup.substring_dedup,
    "bpe": lambda d: byte_bpe.round_trip(d, BYTE_BPE, public_tokenizers.PATTERN),
    "windows": window_dedup.window_dedup,
    "pii": lambda d: pii.find(d, pii.fit(d)),
    "exact": exact_dedup.exact_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(edges, empty, name):
    out = OPERATORS[name](edges).collect()
    assert len(out) >= len(EDGES)
    assert Counter(r.doc_id for r in out).keys() == {*range(len(EDGES) - 2), None}
    assert OPERATORS[name](empty).collect() == []


# ---- 1
def test_media_round_trip_and_pixels():
    rng = np.random.default_rng(0)
    payloads = [progressive_jpeg.padded(rng.integers(lo, hi, n, dtype=np.uint8)) for lo, hi, n in ((0, 256, 5000), (120, 136, 4000), (128, 129, 700), (0, 256, 1), (97, 123, 9000))]
    files = progressive_jpeg.write_many(payloads)
    together = progressive_jpeg.decode_many(files)
    for p, f, im, t in zip(payloads, files, together, progressive_jpeg.rgb(together)):
        assert np.array_equal(progressive_jpeg.payload_of(im), p)
        assert np.array_equal(progressive_jpeg.rgb(progressive_jpeg.decode_many([f]))[0], t) and t.shape == (im.height, im.width, 3)


def test_pixels_by_the_formula():
    """Each pixel of a small image from the cosine sums and the colour formula, within the rounding of fixed-point weights."""
    im = progressive_jpeg.decode_many(progressive_jpeg.write_many([progressive_jpeg.padded(np.random.default_rng(4).integers(118, 139, 300, dtype=np.uint8))]))[0]
    own = []
    for c, (_, h, v, q) in enumerate(im.components):
        _, _, gh, gw = im.grid(c)
        plane = np.zeros((8 * gh, 8 * gw))
        for b in range(gh * gw):
            f = np.zeros((8, 8))
            for k, z in enumerate(progressive_jpeg.ZIGZAG):
                f[z // 8, z % 8] = im.coefficients[c][b][k] * im.quantization[q][k]
            for y in range(8):
                for x in range(8):
                    total = sum((0.5**0.5 if not u else 1) * (0.5**0.5 if not w else 1) * f[w, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * w * np.pi / 16) for u in range(8) for w in range(8) if f[w, u])
                    plane[8 * (b // gw) + y, 8 * (b % gw) + x] = total / 4 + 128
        own.append(np.clip(plane, 0, 255))
    t = progressive_jpeg.rgb([im])[0].astype(int)
    for y in range(0, im.height, 3):
        for x in range(0, im.width, 3):
            luma, cb, cr = own[0][y, x], own[1][y // 2, x // 2] - 128, own[2][y // 2, x // 2] - 128
            want = np.clip([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], 0, 255)
            assert np.abs(t[y, x] - want).max() <= 2.5


def plain_decode(data):
    """A straightforward reader of one image, symbol by symbol."""
    im = progressive_jpeg.parse(data)
    out = [np.zeros((im.grid(c)[2] * im.grid(c)[3], 64), int) for c in range(3)]
    hm, vm = max(c[1] for c in im.components), max(c[2] for c in im.components)
    uw, uh = -(-im.width // (8 * hm)), -(-im.height // (8 * vm))
    for s in im.scans:
        if len(s.components) == 1:
            c = s.components[0]
            h, w, _, gw = im.grid(c)
            order = [(c, y * gw + x) for y in range(h) for x in range(w)]
            unit = 1
        else:
            order = [(c, (uy * im.components[c][2] + y) * im.grid(c)[3] + ux * im.components[c][1] + x) for uy in range(uh) for ux in range(uw) for c in s.components for y in range(im.components[c][2]) for x in range(im.components[c][1])]
            unit = len(order) // (uw * uh)
        size = unit * s.restart or len(order)
        for k, part in enumerate(s.intervals):
            bits = "".join(f"{b:08b}" for b in part) + "1" * 64
            at, pred, run = 0, [0] * 3, 0

            def take(n):
                nonlocal at
                at += n
                return int(bits[at - n : at] or "0", 2)

            def code(table):
                nonlocal at
                value, i = 0, 16
                for n in range(16):
                    value = value * 2 + int(bits[at])
                    at += 1
                    first = 0
                    for j in range(n + 1):
                        first = (first + (table[j - 1] if j else 0)) << 1
                    if value - first < table[n]:
                        return table[i + value - first]
                    i += table[n]

            def extend(v, n):
                return v if not n or v >= 1 << (n - 1) else v - (1 << n) + 1

            for c, b in order[k * size : (k + 1) * size]:
                blk = out[c][b]
                table = s.tables[s.components.index(c)]
                if not s.lo:
                    if s.high:
                        blk[0] |= take(1) << s.low
                    else:
                        n = code(table[0])
                        pred[c] += extend(take(n), n)
                        blk[0] = pred[c] << s.low
                    continue
                i = s.lo
                if not run:
                    while i <= s.hi:
                        rs = code(table[1])
                        r, n = rs >> 4, rs & 15
                        if not n and r < 15:
                            run = (1 << r) + (take(r) if r else 0)
                            break
                        value = extend(take(n), n) if not s.high else (1 if n and take(1) else -1)
                        if not s.high:
                            i += r
                            if n:
                                blk[i] = value << s.low
                            i += 1
                            continue
                        while i <= s.hi:
                            if blk[i]:
                                blk[i] += (take(1) << s.low) * (1 if blk[i] > 0 else -1)
                            elif r:
                                r -= 1
                            else:
                                break
                            i += 1
                        if n:
                            blk[i] = value << s.low
                        i += 1
                if run:
                    if s.high:
                        for i in range(i, s.hi + 1):
                            if blk[i]:
                                blk[i] += (take(1) << s.low) * (1 if blk[i] > 0 else -1)
                    run -= 1
    return out


def test_media_against_plain_reader():
    rng = np.random.default_rng(1)
    for lo, hi in ((0, 256), (124, 133), (32, 120)):
        f = progressive_jpeg.write_many([progressive_jpeg.padded(rng.integers(lo, hi, 700, dtype=np.uint8))])[0]
        im = progressive_jpeg.decode_many([f])[0]
        assert all(np.array_equal(a, b) for a, b in zip(plain_decode(f), im.coefficients))


def test_media_tensors(spark):
    f = progressive_jpeg.write_many([np.arange(64, dtype=np.uint8)])[0]
    df = spark.createDataFrame([(1, bytearray(f)), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    r = {x.doc_id: x for x in progressive_jpeg.tensors(df).collect()}
    assert len(r[1].rgb) == r[1].height * r[1].width * 3 and r[2].rgb is None and r[3].rgb is None
    kept = progressive_jpeg.digest(progressive_jpeg.store(frame(spark, ["a text", None])), with_rgb=True).collect()
    assert all(hashlib.sha256(x.rgb).hexdigest() == x.rgb_sha256 and len(x.rgb) == 3 * x.height * x.width for x in kept)


# ---- 2
def test_machine_identity():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.3, rng.random(quality_fm.SIZE).astype(np.float32), rng.random((quality_fm.SIZE, 4)).astype(np.float32))
    ids, x = np.array([3, 8, 11], np.int32), np.array([0.5, 1.5, 2.0], np.float32)
    want = 0.3 + float(m.w[ids] @ x) + sum(float(m.v[a] @ m.v[b]) * p * q for (a, p), (b, q) in itertools.combinations(zip(ids, x), 2))
    assert m.raw(np.array([0]), ids, x)[0][0] == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_fm.op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    assert out.score.between(0, 1).all()


# ---- 3
def test_ids_equal_library(texts):
    tok, fresh = packing.WordBPE(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(3)
    parts = ["a", "AA", " ", "\n", "é", "É", "日本", "🙂", "́", "'s", "'RE", "1", "00", "\x00", "--", "\x85", "\xa0", "\x1c", "ß", "İ", "²", "ſ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]
    for t in [*list(texts.values())[:40], *("".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500))]:
        assert np.frombuffer(tok.encode_packed(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_fullest_is_exhaustive():
    rng = random.Random(4)
    for _ in range(200):
        have = sorted(((rng.randrange(1, 40), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 6))), reverse=True)
        have = sorted(dict(have).items(), reverse=True)
        room = rng.randrange(1, 90)
        best = max(s for c in itertools.product(*(range(n + 1) for _, n in have)) if (s := sum(k * x for k, (x, _) in zip(c, have))) <= room)
        got = packing.fullest(room, have)
        assert sum(k * v for k, v in got.items()) == best and all(v <= dict(have)[k] for k, v in got.items())


def test_packing_is_exact(docs):
    rows = packing.pack_documents(docs).toPandas()
    whole = Tokenizer.from_file(WORD_BPE)
    for r in docs.limit(20).collect():
        ids = [*whole.encode(r.text, add_special_tokens=False).ids, 0]
        own = rows[rows.doc_id == r.doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[:-1] == 2048).all() and own.start.tolist() == list(range(0, len(ids), 2048))
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1


def test_assembled_sequences(spark):
    table = packing.pieces(frame(spark, ["a b c", "d e", "f"]), WORD_BPE, 8, with_ids=True)
    placed = packing.pack(table.persist(), 8)
    ids = {r.sequence_id: list(r.ids) for r in packing.assemble(placed).collect()}
    for r in placed.collect():
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)


# ---- 4
def plain_lines(docs):
    norm = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    seen, out = [], {}
    for d, t in sorted(docs.items()):
        kept = []
        for line in t.split("\n"):
            n = norm(line)
            if len(n) >= line_dedup.SHORTEST:
                hit = any(n == p or (min(len(n), len(p)) >= line_dedup.FUZZY and near(n, p)) for p in seen)
                seen.append(n)
                if hit:
                    continue
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    base = ["the quick brown fox jumps over the dog", "la lumière é était très belle ce soir", "short line", "a" * 26, "x", "", "  Indented Line of Twenty+ chars\t"]

    def edit(s):
        i, c = rng.randrange(len(s) + 1), rng.choice("aé日b ")
        return rng.choice([s[:i] + c + s[i:], s[: max(i - 1, 0)] + s[i:], s[: max(i - 1, 0)] + c + s[i:], s, s.upper()])

    docs = {k: "\n".join(edit(edit(rng.choice(base))) for _ in range(rng.randrange(12))) for k in range(50)}
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, list(docs.values()))).collect()}
    assert got == plain_lines(docs)


# ---- 5
def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [64, 1])
def test_near_duplicates_against_brute_force(docs, texts, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert all(int(out[d].fingerprint, 16) == v for d, v in fp.items())
    root = {d: d for d in fp}
    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4 and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = {d: x if r == y else r for d, r in root.items()}
    assert {d: r.component_id for d, r in out.items()} == root


# ---- 6, 8
def test_strings_against_brute_force(spark, docs, texts):
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdé ", k=230))
    more = {**texts, 10_000: passage + "q", 10_001: "z" + passage[3:], 10_002: "y" * 900, 10_003: passage * 2}
    count = Counter(b[i : i + 200] for t in more.values() for b in [t.encode()] for i in range(len(b) - 199))
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, list(more.values()), list(more)), digest=True).collect()}
    for d, t in more.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (out[d].n_bytes, out[d].n_removed, out[d].n_spans, out[d].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_windows_against_brute_force(spark, texts):
    more = {**texts, 10_000: " ".join("ab"[i % 2] for i in range(60)), 10_001: "one two three " * 30}
    seen, out = set(), {r.doc_id: r for r in window_dedup.window_dedup(frame(spark, list(more.values()), list(more))).collect()}
    for d, t in sorted(more.items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        assert (out[d].n_words, out[d].n_removed, out[d].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))


# ---- 7
def test_bpe_equals_tiktoken(texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = byte_bpe.ByteBPE(BYTE_BPE, public_tokenizers.PATTERN)
    rng = random.Random(7)
    parts = ["a", "aa", " ", "\n", "  ", "é", "日本", "🙂", "́", "'s", "1", "0000", "ing", "\x00", "====", "\x1c", "\x85", "क", "ह", "²", "ababab"]
    for t in [*list(texts.values())[:60], *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(2000))]:
        ids = ref.encode_ordinary(t)
        assert tok.encode(t) == ids and tok.decode(ids) == t and "".join(tok.decode_stream(ids)) == t
    for t in ("".join(rng.choices("日本語文字", k=100_000)), "x" * 300_000, "ab" * 100_000, "=" * 30_001):  # single pre-tokens
        assert tok.decode(tok.encode(t)) == t and tok.encode(t[:20_001]) == ref.encode_ordinary(t[:20_001])
        assert tok.merge(t[:3000].encode()) == ref.encode_ordinary(t[:3000])
    cut = tok.encode("🙂🙂")[:-1]
    assert tok.decode(cut).endswith("�") and tok.offsets(cut)[-1][1] == len(tok.decode_bytes(cut))


# ---- 9
def test_base_spans_equal_plain_rules():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(9)
    parts = [*"0123456789..@@+-- ()aé%_", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (974) 555-3436", "256", "٣"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randrange(26)))
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(pii.digits_of(m[0])) <= 15]
        assert pii.base_spans(t) == want


def planted(seed, n):
    """Texts with personal data and look-alikes: (text, spans beside the base rules)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(5, 25)))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    bad_card = lambda: next(d for _ in iter(int, 1) if not pii.luhn(d := digits(16)))
    make = {
        "email": lambda: (rng.choice(["mail ", "contact "]), f"{word()} (at) {word()} (dot) com"),
        "phone": lambda: (rng.choice(["call ", "tel ", "phone: "]), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        "secret": lambda: (rng.choice(["token = ", "api key: ", "password "]), "".join(rng.choices("abcdef0123456789", k=40))),
        "order": lambda: ("order ", digits(8)),
        "rule": lambda: ("section ", word() + "_" * 20 + digits(1)),
        "bad card": lambda: ("", bad_card()),
    }
    out = []
    for _ in range(n):
        text, true = prose() + " ", set()
        for kind in rng.choices(list(make), k=rng.randrange(4)):
            lead, span = make[kind]()
            at = len(text) + len(lead)
            text += lead + span + ". " + prose() + " "
            if kind in pii.KINDS:
                true.add((kind, at, at + len(span)))
        out.append((text, true))
    return out


def test_added_spans_and_reliabilities(spark):
    model = pii.fit(frame(spark, [t for t, _ in planted(1, 2000)]))
    right = wrong = missed = 0
    for text, true in planted(2, 1000):
        got = set(pii.all_spans(text, model)) - set(pii.base_spans(text))
        right, wrong, missed = right + len(got & true), wrong + len(got - true), missed + len(true - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95 and right > 400


def test_estimated_reliabilities():
    """Votes drawn from known rates: expectation-maximisation finds the rates, also where they are far from its start."""
    rng = np.random.default_rng(11)
    true = rng.random(40_000) < 0.3
    rates = {"pattern": (0.8, 0.3), "gazetteer": (0.7, 0.05), "context": (0.6, 0.5), "checksum": (0.9, 0.2)}
    votes = [np.where(rng.random(len(true)) < np.where(true, *rates[x]), pii.YES, pii.NO) for x in pii.LABELERS]
    rows, n = np.unique(np.stack([np.zeros(len(true), int), *votes], axis=1), axis=0, return_counts=True)
    p, found = pii.estimate(rows, n)
    for x in pii.LABELERS:
        assert np.allclose(found["email", x], rates[x], atol=0.05)
    assert abs((p @ n) / n.sum() - 0.3) < 0.05


def test_redaction(spark):
    df = frame(spark, ["write to a.b@c.org or +1 (974) 555-3436 now", None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "card 2390409500648961 fails"])
    out = {r.doc_id: r.text for r in pii.redact(df, pii.fit(df)).collect()}
    assert out[0] == "write to <EMAIL> or <PHONE> now" and out[1] is None and out[3] == "card 2390409500648961 fails"


# ---- 10
def test_fingerprints_compose():
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 256, 40_000, dtype=np.uint8), rng.integers(0, 256, 17, dtype=np.uint8)
    whole = exact_dedup.fingerprint(np.concatenate((a, b)))
    assert whole == exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b))
    assert whole == int.from_bytes(b"", "big") + sum(int(x) * pow(exact_dedup.BASE, len(a) + len(b) - 1 - i, exact_dedup.P61) for i, x in enumerate(np.concatenate((a, b)))) % exact_dedup.P61


def test_exact_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BASE", 1)  # driver only; workers hash as ever
    t = ["Ab", "aB", None, "", "É", "é", "z" * 40_000, "Z" * 40_000]
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, t)).collect()}
    assert [out[i].keep_id for i in range(8)] == [1, 1, 3, 3, 4, 5, 7, 7] and [out[i].kept for i in range(8)] == [False, True, False, True, True, True, False, True]
    assert out[0].text_sha256 == hashlib.sha256(b"ab").hexdigest() and out[0].group_size == 2


# ---- pipeline
def test_pipeline_stages(spark, docs):
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = own.count()
        own = stage(spark, own, SF).persist()
        assert own.columns == docs.columns and own.dtypes == docs.dtypes
        assert own.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, own, SF).select("doc_id").distinct().count() == own.select("doc_id").distinct().count()


def plain_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("crowd", [16, 2])
def test_pipeline_links_texts_of_four_fifths(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "MANY", crowd)
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 8):  # similarity about 0.94, 0.88, 0.82 and 0.6
            own = list(base)
            for i in rng.sample(range(5, 145), edits):
                own[i] = "new"
            texts.append(" ".join(own))
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), SF).collect()}
    assert kept == set(root) and len(kept) < 120
