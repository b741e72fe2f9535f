"""Progressive JPEG as a media column (operator 1): a writer, a reader, and full-resolution RGB tensors.

The reader parses markers, then runs every scan over all restart intervals of all images in a batch at once: an interval
is a lane with its own bit position, and one numpy step decodes one symbol in each lane.  First scans fill coefficient
arrays by spectral selection; refining scans add one bit of precision (successive approximation), their correction bits
gathered in bulk after the symbols.  Coefficients are dequantized and inverse-transformed in numpy with integer-valued
weights (exact in float64, so equal images give equal pixels in any batch), chroma is upsampled by repetition, and the
result is stored as a full-resolution RGB tensor.

Payload bytes are stored losslessly as quantized coefficients (the format's unit, 64 to a block) of a 4:2:0 image whose
quantization steps are 1; pixels would lose bits, coefficients do not.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import documents, per_slice, slices, text_bytes


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
#: Blocks of a minimum coded unit at 4:2:0 in scan order: component, row and column in the unit.
UNIT = ((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0))
#: Component (0 luma), spectral band, and bits before and after of each scan the writer makes; None: all components together.
SCRIPT = ((None, 0, 0, 0, 1), *((c, 1, 5, 0, 1) for c in range(3)), *((c, 6, 63, 0, 0) for c in range(3)), (None, 0, 0, 1, 0), *((c, 1, 5, 1, 0) for c in range(3)))
#: Restart interval of scans of all components (units) and of one component (blocks); short, so that many are read side by side.
RESTART = {True: 8, False: 8}
#: Lanes that are decoded together.
LANES = 1 << 13


# ---- Huffman tables -------------------------------------------------------------------------------------------------
def _canonical(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as a DHT segment has it; `lengths`: symbol and code length."""
    rows = sorted(lengths, key=lambda x: x[1])
    code, last = 0, rows[0][1]
    codes, sizes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64), [0] * 16
    for symbol, n in rows:
        code <<= n - last
        last = n
        codes[symbol], sizes[symbol] = code, n
        bits[n - 1] += 1
        code += 1
    return codes, sizes, bytes(bits) + bytes(s for s, _ in rows)


def _lengths(weights: dict[int, float]) -> list[tuple[int, int]]:
    """Code lengths of a Huffman code over the symbols and one that no code may be (all ones), at most 16 bits."""
    import heapq

    least = max(weights.values()) / 2**10
    heap = [(max(w, least), i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(least / 4, -1, (-1,))]
    heapq.heapify(heap)
    depth: dict[int, int] = defaultdict(int)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heap.append((a[0] + b[0], tick, a[2] + b[2]))
        heapq.heapify(heap)
        tick += 1
    out = sorted(((s, n) for s, n in depth.items() if s >= 0), key=lambda x: (x[1], x[0]))
    deepest = max(n for _, n in out)
    if deepest > 16:
        raise ValueError("code too long")
    return out


def _ac_weights() -> dict[int, float]:
    """Every run and size that 8-bit payload can make, the likelier the shorter; end of block and long zero runs too."""
    out = {16 * run + size: 4.0 ** -run * (1 if size >= 5 else 0.1) for run in range(16) for size in range(1, 11)}
    return out | {0x00: 0.2, 0xF0: 0.001}


DC_TABLE = _canonical(_lengths({size: 1.0 if size in (4, 5, 6) else 0.2 for size in range(12)}))
AC_TABLE = _canonical(_lengths(_ac_weights()))


@lru_cache(16)
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that can follow: 256 * code length + symbol (0: no code)."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[k]
            code += 1
            k += 1
        code <<= 1
    return out


# ---- writing --------------------------------------------------------------------------------------------------------
def _pack_bits(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bits of each interval, filled up with ones and with a zero byte after each 255.  sizes: under 32; counts: codes in each interval, none empty."""
    ends = np.cumsum(counts)
    before = np.cumsum(sizes, dtype=np.int64)
    total = np.diff(before[ends - 1], prepend=0)
    length = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(length)))
    at = before - sizes + np.repeat(8 * start[:-1] - (np.cumsum(total) - total), counts)
    fill = np.flatnonzero(8 * length > total)
    gap = 8 * length[fill] - total[fill]
    words = np.zeros(int(start[-1]) // 4 + 3, np.uint64)
    for p, v, n in ((at, values, sizes), (8 * start[fill] + total[fill], (1 << gap) - 1, gap)):
        if len(p):
            w = p >> 5
            x = v.astype(np.uint64) << (64 - (p & 31) - n).astype(np.uint64)
            heads = np.flatnonzero(w[1:] != w[:-1])
            heads = np.concatenate(([0], heads + 1))
            w = w[heads]
            words[w] |= np.bitwise_or.reduceat(x >> np.uint64(32), heads)
            words[w + 1] |= np.bitwise_or.reduceat(x & np.uint64(0xFFFFFFFF), heads)
    data = words.astype(">u4").tobytes()
    cuts = start.tolist()
    return [data[i:j].replace(b"\xff", b"\xff\0") for i, j in zip(cuts[:-1], cuts[1:])]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _ones(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits after a size: the value, or for a negative one its ones' complement."""
    return np.where(v < 0, v + (1 << size) - 1, v)


def _dc_first(dc: np.ndarray, component: np.ndarray, interval: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
    v = dc.astype(np.int64) >> low
    diff = v.copy()
    for c in range(3):
        own = np.flatnonzero(component == c)
        if len(own) > 1:
            same = interval[own[1:]] == interval[own[:-1]]
            diff[own[1:]] -= np.where(same, v[own[:-1]], 0)
    size = _size(diff)
    codes, sizes, _ = DC_TABLE
    return codes[size] << size | _ones(diff, size), sizes[size] + size, np.ones(len(v), np.int64)


@lru_cache(8)
def _runless(low: int) -> tuple[np.ndarray, np.ndarray]:
    """Code with its bits, and their number (0 for a zero), of each coefficient from -1024 on that no zeros stand before."""
    b = np.arange(-1024, 1024)
    v = np.sign(b) * (np.abs(b) >> low)
    size = _size(v)
    codes, sizes, _ = AC_TABLE
    size = np.minimum(size, 10)
    return np.where(v, codes[size] << size | _ones(v, size), 0), np.where(v, sizes[size] + size, 0)


def _ac_first(block: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, ...]:
    band = block[:, lo : hi + 1]
    width, n = hi - lo + 1, len(band)
    values, lengths = _runless(low)
    place = band.astype(np.intp)
    place += 1024
    bits = lengths[place]
    whole = bits.all(axis=1)
    if whole.all():
        return values[place].reshape(-1), bits.reshape(-1), np.full(n, width)
    rows = np.flatnonzero(~whole)
    some_v, some_s, some_n = _ac_runs(band[rows], low)
    total = np.full(n, width)
    total[rows] = some_n
    begins = np.cumsum(total) - total
    out_v, out_s = np.empty(int(begins[-1] + total[-1]), np.int64), np.empty(int(begins[-1] + total[-1]), np.int64)
    rest = np.ones(len(out_v), bool)
    at = np.repeat(begins[rows] - (np.cumsum(some_n) - some_n), some_n) + np.arange(len(some_v))
    out_v[at], out_s[at], rest[at] = some_v, some_s, False
    out_v[rest], out_s[rest] = values[place[whole]].reshape(-1), bits[whole].reshape(-1)
    return out_v, out_s, total


def _ac_runs(band: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
    """Codes of blocks that have zeros in the band."""
    n, width = band.shape
    codes, sizes, _ = AC_TABLE
    x = band.reshape(-1).astype(np.int64)
    x = np.sign(x) * (np.abs(x) >> low)
    flat = np.flatnonzero(x)
    x = x[flat]
    b, k = np.divmod(flat, width)
    head = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
    run = k - np.where(head, 0, np.concatenate(([0], k[:-1] + 1))) if len(b) else k
    size = _size(x)
    symbol = (run & 15) << 4 | size
    value, bits = codes[symbol] << size | _ones(x, size), sizes[symbol] + size
    full = np.zeros(n, bool)
    full[b[k == width - 1]] = True
    # zero runs of 16 stand before their coefficient, an end of block after the last one
    each = 1 + (run >> 4)
    count = np.bincount(b, each, n).astype(np.int64)
    total = count + ~full
    begins = np.cumsum(total) - total
    within = np.cumsum(each) - 1 - np.concatenate(([0], np.cumsum(count)))[:-1][b]
    out_v, out_s = np.full(int(total.sum()), codes[0xF0]), np.full(int(total.sum()), sizes[0xF0])
    out_v[begins[b] + within], out_s[begins[b] + within] = value, bits
    ends = (begins + count)[~full]
    out_v[ends], out_s[ends] = codes[0], sizes[0]
    return out_v, out_s, total


def _ac_refine(block: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, ...]:
    band = block[:, lo : hi + 1].astype(np.int32)
    m = np.abs(band) >> low
    n, width = m.shape
    codes, sizes, _ = AC_TABLE
    old, new = m > 1, m == 1
    # a symbol stands at each new coefficient, and at every 16th zero since the last one if a new one follows
    zeros = np.cumsum(~old & ~new, axis=1)
    at_new = np.where(new, zeros, 0)
    last = np.maximum.accumulate(at_new, axis=1)
    last = np.concatenate((np.zeros((n, 1), last.dtype), last[:, :-1]), axis=1)
    more = np.flip(np.maximum.accumulate(np.flip(new, 1), axis=1), 1)
    skip = ~old & ~new & more & ((zeros - last) % 16 == 0) & (zeros > last)
    stop = new | skip
    done = np.cumsum(stop, axis=1)
    stops = done[:, -1]
    open_end = ~stop[:, -1]
    symbols = stops + open_end
    olds = np.cumsum(old, axis=1)
    per_block = symbols + olds[:, -1]
    begins = np.cumsum(per_block) - per_block
    b, k = np.nonzero(old)
    group = done[b, k]  # symbols before it, without its own
    out_v, out_s = np.zeros(int(per_block.sum()), np.int64), np.zeros(int(per_block.sum()), np.int64)
    place = begins[b] + np.minimum(group + 1, symbols[b]) + olds[b, k] - 1
    out_v[place], out_s[place] = m[b, k] & 1, 1
    sb, sk = np.nonzero(stop)
    # old coefficients in groups before this symbol's own
    prev = np.zeros(len(sb), np.int64)
    if len(sb):
        same = np.concatenate(([False], sb[1:] == sb[:-1]))
        prev[1:] = np.where(same[1:], olds[sb[:-1], sk[:-1]], 0)
    place = begins[sb] + done[sb, sk] - 1 + prev
    is_new = new[sb, sk]
    symbol = np.where(is_new, (zeros - last)[sb, sk] % 16 << 4 | 1, 0xF0)
    sign = (band[sb, sk] > 0).astype(np.int64)
    out_v[place] = np.where(is_new, codes[symbol] << 1 | sign, codes[symbol])
    out_s[place] = sizes[symbol] + is_new
    eb = np.flatnonzero(open_end)
    tail = np.zeros(n, np.int64)  # old coefficients before the last stop
    np.maximum.at(tail, sb, olds[sb, sk])
    place = begins[eb] + stops[eb] + tail[eb]
    out_v[place], out_s[place] = codes[0], sizes[0]
    return out_v, out_s, per_block


@dataclass
class Layout:
    """How the blocks of a 4:2:0 image lie in the flat order in which payload fills them (unit by unit)."""

    units: int
    wide: int
    high: int
    component: np.ndarray = field(repr=False)
    #: For each component, its blocks (places in the flat order) in raster order.
    raster: list[np.ndarray] = field(repr=False)

    @staticmethod
    @lru_cache(4096)
    def of(wide: int, high: int) -> Layout:
        n = wide * high
        uy, ux = np.divmod(np.arange(n), wide)
        raster = []
        for c in range(3):
            s = 2 if c == 0 else 1
            grid = np.zeros((high * s, wide * s), np.int64)
            for j, (comp, y, x) in enumerate(UNIT):
                if comp == c:
                    grid[uy * s + y, ux * s + x] = np.arange(n) * 6 + j
            raster.append(grid.reshape(-1))
        return Layout(n, wide, high, np.tile(np.array([u[0] for u in UNIT]), n), raster)


def _together(script: tuple) -> list[list[tuple]]:
    """Neighbouring scans that differ in nothing but the component."""
    out: list[list[tuple]] = []
    for scan in script:
        if out and scan[0] is not None and out[-1][0][0] is not None and out[-1][0][1:] == scan[1:]:
            out[-1].append(scan)
        else:
            out.append([scan])
    return out


@lru_cache(4096)
def _all(blocks: int) -> np.ndarray:
    return np.arange(blocks)


@lru_cache(4096)
def _intervals(blocks: int, size: int) -> np.ndarray:
    """Blocks in each restart interval."""
    return np.diff(np.append(np.arange(0, blocks, size), blocks))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def write_many(payloads: list[np.ndarray]) -> list[bytes]:
    """A progressive JPEG for each payload of 64*k bytes, k > 0: byte b is the quantized coefficient b - 128."""
    layouts, blocks = [], []
    for p in payloads:
        units = -(-len(p) // 384)
        wide = min(4095, max(1, int(units**0.5)))
        high = -(-units // wide)
        layouts.append(Layout.of(wide, high))
        own = np.zeros((wide * high * 6, 64), np.int16)
        own.reshape(-1)[: len(p)] = p.astype(np.int16) - 128
        blocks.append(own)
    coefficient = np.concatenate(blocks)
    first_block = np.concatenate(([0], np.cumsum([6 * x.units for x in layouts])))
    streams: list[list[list[bytes]]] = [[] for _ in payloads]
    for scans in _together(SCRIPT):
        _, lo, hi, high_bit, low = scans[0]
        orders = [_all(6 * x.units) if comp is None else x.raster[comp] for comp, *_ in scans for x in layouts]
        size = 6 * RESTART[True] if scans[0][0] is None else RESTART[False]
        counts = [_intervals(len(x), size) for x in orders]
        rows = np.concatenate(orders) + np.repeat(np.tile(first_block[:-1], len(scans)), [len(x) for x in orders])
        owners = [*range(len(layouts))] * len(scans)
        blocks = np.concatenate(counts)
        if lo:
            values, bits, each = (_ac_refine if high_bit else _ac_first)(coefficient[rows], lo, hi, low)
        elif high_bit:
            values, bits, each = (coefficient[rows, 0].astype(np.int64) >> low) & 1, np.ones(len(rows), np.int64), np.ones(len(rows), np.int64)
        else:
            values, bits, each = _dc_first(coefficient[rows, 0], np.concatenate([x.component for x in layouts]), np.repeat(np.arange(len(blocks)), blocks), low)
        parts = _pack_bits(values, bits, np.diff(np.cumsum(each)[np.cumsum(blocks) - 1], prepend=0))
        k = 0
        for i, c in zip(owners, counts):
            streams[i].append(parts[k : k + len(c)])
            k += len(c)
    out = []
    for p, x, own in zip(payloads, layouts, streams):
        sof = bytes((8,)) + (x.high * 16).to_bytes(2, "big") + (x.wide * 16).to_bytes(2, "big") + bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
        file = [b"\xff\xd8", _segment(0xFE, b"payload " + str(len(p)).encode()), TABLES, _segment(0xC2, sof)]
        for header, parts in zip(HEADERS, own):
            marked = [header] * (2 * len(parts))
            marked[1::2] = parts
            marked[2::2] = (MARKS * (len(parts) // 8 + 1))[: len(parts) - 1]
            file += marked
        out.append(b"".join([*file, b"\xff\xd9"]))
    return out


MARKS = [bytes((0xFF, 0xD0 + i)) for i in range(8)]
TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + DC_TABLE[2]) + _segment(0xC4, b"\x10" + AC_TABLE[2])
HEADERS = [_segment(0xDD, RESTART[c is None].to_bytes(2, "big")) + _segment(0xDA, bytes((3 if c is None else 1,)) + b"".join(bytes((i, 0)) for i in ((1, 2, 3) if c is None else (c + 1,))) + bytes((lo, hi, high << 4 | low))) for c, lo, hi, high, low in SCRIPT]


# ---- reading --------------------------------------------------------------------------------------------------------
@dataclass
class Scan:
    components: list[int]
    lo: int
    hi: int
    high: int
    low: int
    restart: int
    tables: list[tuple[bytes, bytes]]
    intervals: list[bytes]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: identifier, horizontal and vertical sampling, quantization table
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)
    #: For each component, blocks x 64 in zigzag order, blocks in raster order of the padded grid.
    coefficients: list[np.ndarray] = field(default_factory=list)

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Rows and columns of blocks that a scan of one component has, and of the padded grid."""
        hm, vm = max(x[1] for x in self.components), max(x[2] for x in self.components)
        _, h, v, _ = self.components[c]
        uw, uh = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        return -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8), uh * v, uw * h


def parse(data: bytes) -> Image:
    """Markers and entropy-coded intervals of a progressive JPEG; ValueError if it is anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at, restart = Image(), 2, 0
    tables: dict[int, bytes] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                size = 64 * (2 if wide else 1)
                image.quantization[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                k += 1 + size
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                size = 16 + sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 1 + size]
                k += 1 + size
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if len(image.components) == 1:
                image.components = [(image.components[0][0], 1, 1, image.components[0][3])]
            if body[0] != 8 or not image.height or not image.width:
                raise ValueError("8-bit samples and a size are needed")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman JPEG")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            chosen = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
            own = [(tables.get(body[2 + 2 * i] >> 4, b""), tables.get(16 | body[2 + 2 * i] & 15, b"")) for i in range(body[0])]
            lo, hi, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = SCAN_END.search(data, at)
            end = end.start() if end else len(data)
            intervals = RESTARTS.split(data[at:end])
            at = end
            image.scans.append(Scan(chosen, lo, hi, bits >> 4, bits & 15, restart, own, [x.replace(b"\xff\0", b"\xff") for x in intervals]))
    if not image.components:
        raise ValueError("no frame")
    return image


SCAN_END = re.compile(b"\xff[^\x00\xd0-\xd7\xff]")
RESTARTS = re.compile(b"\xff[\xd0-\xd7]")


class Lanes:
    """Bit positions in many intervals that are read side by side."""

    def __init__(self, intervals: list[bytes]):
        self.data = (b"\xff" * 16).join([*intervals, b"\xff" * 8])  # as many ones follow as any symbol takes
        sizes = np.array([len(x) for x in intervals], np.int64)
        self.window = np.ndarray((len(self.data) - 7,), ">u8", self.data, 0, (1,))  # eight bytes from each byte on
        self.at = 8 * (np.cumsum(sizes + 16) - sizes - 16)
        self.end = self.at + 8 * (sizes + 8)

    def peek(self, lane: np.ndarray) -> np.ndarray:
        """57 bits or more from the lane's position on, at the top of a word."""
        at = self.at[lane]
        return self.window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def bits(self, at: np.ndarray) -> np.ndarray:
        """Single bits."""
        raw = np.frombuffer(self.data, np.uint8)
        return (raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.int64)

    def guard(self, lane: np.ndarray) -> None:
        if len(lane) and (self.at[lane] > self.end[lane]).any():
            raise ValueError("the entropy-coded data ends early")


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((bits < (1 << size >> 1)) & (size > 0), bits - (1 << size) + 1, bits)


def _take(word: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`size` bits (under 32) after `skip`."""
    x = word << skip.astype(np.uint64) >> np.uint64(32)
    return (x >> (32 - size).astype(np.uint64)).astype(np.int64)


def _read_dc(lanes: Lanes, steps: np.ndarray, place: np.ndarray, comp: np.ndarray, tables: list[np.ndarray], out: np.ndarray, scan: Scan) -> None:
    """place, comp: lanes x the most steps; the block in `out` and the component (by its order in the scan) of each step."""
    last = np.zeros((len(steps), 4), np.int64)
    look = np.concatenate(tables) if not scan.high else None
    for k in range(int(steps.max(initial=0))):
        lane = np.flatnonzero(steps > k)
        at = place[lane, k]
        if scan.high:
            out[at, 0] |= (lanes.bits(lanes.at[lane]) << scan.low).astype(np.int16)
            lanes.at[lane] += 1
        else:
            c = comp[lane, k]
            word = lanes.peek(lane)
            found = look[(word >> np.uint64(48)).astype(np.int64) + (c << 16)]
            size, used = found & 255, found >> 8
            if (used == 0).any():
                raise ValueError("no such code")
            last[lane, c] += _extend(_take(word, used, size.astype(np.int64)), size.astype(np.int64))
            out[at, 0] = last[lane, c] << scan.low
            lanes.at[lane] += used + size
        lanes.guard(lane)


def _read_ac_first(lanes: Lanes, blocks: np.ndarray, first: np.ndarray, order: np.ndarray, look: np.ndarray, out: np.ndarray, scan: Scan) -> None:
    """blocks, first: how many blocks each lane has, and where they begin in `order`, which has their rows in `out`."""
    flat = out.reshape(-1)
    lane = np.flatnonzero(blocks > 0)
    b, k = np.zeros(len(blocks), np.int64), np.full(len(blocks), scan.lo, np.int64)
    while len(lane):
        word = lanes.peek(lane)
        found = look[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, symbol = found >> 8, found & 255
        run, size = symbol >> 4, symbol & 15
        taken = np.where((size == 0) & (run < 15), run, size)
        extra = _take(word, used, taken)
        lanes.at[lane] += used + taken
        own = size > 0
        kk = k[lane] + run
        ok = own if own.all() else np.flatnonzero(own)
        if (used == 0).any() or (kk[ok] > scan.hi).any():
            raise ValueError("broken scan")
        flat[order[first[lane[ok]] + b[lane[ok]]] * 64 + kk[ok]] = _extend(extra[ok], size[ok]) << scan.low
        kk += 1
        if ok is own:
            full = kk > scan.hi
            b[lane] += full
            k[lane] = np.where(full, scan.lo, kk)
        else:
            ends = ~own & (run < 15)
            skipped = np.where(ends, (1 << run) + np.where(ends, extra, 0), 0)
            full = ends | (kk > scan.hi)
            b[lane] += np.where(ends, skipped, full)
            k[lane] = np.where(full, scan.lo, kk)
        lanes.guard(lane)
        if full.any():
            lane = lane[b[lane] < blocks[lane]]


def _read_ac_refine(lanes: Lanes, blocks: np.ndarray, first: np.ndarray, order: np.ndarray, look: np.ndarray, out: np.ndarray, scan: Scan) -> None:
    lo, width = scan.lo, scan.hi - scan.lo + 1
    rows = order  # all blocks of all lanes, lane by lane
    old = out[rows, lo : scan.hi + 1] != 0
    olds = np.concatenate((np.zeros((len(rows), 1), np.int64), np.cumsum(old, axis=1)), axis=1)
    zeros = np.arange(width + 1) - olds
    # place of the j-th zero of each block (width: none)
    zero_at = np.full((len(rows), width + 1), width, np.int64)
    zb, zk = np.nonzero(~old)
    zero_at[zb, zeros[zb, zk]] = zk
    fixes: list[tuple[np.ndarray, ...]] = []
    fresh: list[tuple[np.ndarray, ...]] = []
    lane = np.flatnonzero(blocks > 0)
    b, k = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    while len(lane):
        row = first[lane] + b[lane]
        word = lanes.peek(lane)
        found = look[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, symbol = found >> 8, found & 255
        if (used == 0).any():
            raise ValueError("broken scan")
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        taken = np.where(ends, run, np.where(size > 0, 1, 0))
        extra = _take(word, used, taken)
        lanes.at[lane] += used + taken
        z = zeros[row, k[lane]] + run
        to = np.where(ends, width, zero_at[row, np.minimum(z, width)])
        if (to[~ends] >= width).any():
            raise ValueError("broken scan")
        fixes.append((row, k[lane], to, lanes.at[lane]))
        lanes.at[lane] += olds[row, to] - olds[row, k[lane]]
        new = np.flatnonzero(size > 0)
        fresh.append((row[new], to[new], np.where(extra[new] > 0, 1, -1)))
        # an end of band may close further whole blocks of the lane
        count = np.where(ends, (1 << run) + np.where(ends, extra, 0), 0)
        more = np.flatnonzero(count > 1)
        if len(more):
            n = np.minimum(count[more], blocks[lane[more]] - b[lane[more]]) - 1
            r = np.repeat(row[more] + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = olds[r, width]
            start = np.cumsum(own) - own
            head = np.repeat((np.cumsum(own) - own)[np.minimum(np.cumsum(n) - n, max(len(r) - 1, 0))], n) if len(r) else start
            fixes.append((r, np.zeros(len(r), np.int64), np.full(len(r), width), np.repeat(lanes.at[lane[more]], n) + start - head))
            lanes.at[lane[more]] += np.bincount(np.repeat(np.arange(len(more)), n), own, len(more)).astype(np.int64)
        full = ends | (to + 1 >= width)
        b[lane] += np.where(ends, count, full)
        k[lane] = np.where(full, 0, to + 1)
        lanes.guard(lane)
        lane = lane[b[lane] < blocks[lane]]
    if fixes:
        row, k0, k1, at = (np.concatenate(x) for x in zip(*fixes))
        n = olds[row, k1] - olds[row, k0]
        # the n old coefficients of each piece, in order
        ob, ok = np.nonzero(old)
        block_start = np.concatenate(([0], np.cumsum(olds[:, -1])))[:-1]
        i = np.repeat(block_start[row] + olds[row, k0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bit = lanes.bits(np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        r, kk = rows[ob[i]], lo + ok[i]
        out[r, kk] += (np.sign(out[r, kk]) * (bit << scan.low)).astype(np.int16)
    row, kk, sign = (np.concatenate(x) for x in zip(*fresh)) if fresh else (np.zeros(0, np.int64),) * 3
    out[rows[row], lo + kk] = sign << scan.low


@lru_cache(4096)
def _scan_blocks(width: int, height: int, sampling: tuple, chosen: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in its order (places in each component's padded grid), their components, and blocks of a unit."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    uw, uh = -(-width // (8 * hm)), -(-height // (8 * vm))
    if len(chosen) == 1:
        h, v = sampling[chosen[0]]
        sh, sw = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
        blocks = (np.arange(sh)[:, None] * (uw * h) + np.arange(sw)).reshape(-1)
        return blocks, np.full(len(blocks), chosen[0]), 1
    uy, ux = np.divmod(np.arange(uw * uh), uw)
    parts = [((uy * sampling[c][1] + y) * uw * sampling[c][0] + ux * sampling[c][0] + x, c) for c in chosen for y in range(sampling[c][1]) for x in range(sampling[c][0])]
    return np.stack([p for p, _ in parts], axis=1).reshape(-1), np.tile(np.array([c for _, c in parts]), uw * uh), len(parts)


def _order(comps: np.ndarray, chosen: tuple) -> np.ndarray:
    """The component's number in the scan."""
    to = np.zeros(max(chosen) + 1, np.int64)
    to[list(chosen)] = np.arange(len(chosen))
    return to[comps]


@lru_cache(256)
def _schedule(scans: tuple) -> list[int]:
    """When each scan is read: after earlier ones of its own coefficients, beside all others."""
    turns: list[int] = []
    for chosen, lo, hi in scans:
        turns.append(max((k + 1 for (c, a, b), k in zip(scans, turns) if a <= hi and lo <= b and set(c) & set(chosen)), default=0))
    return turns


def read_coefficients(images: list[Image]) -> None:
    """Fills in `coefficients`: scan by scan in file order, all images' intervals of like scans side by side."""
    base, at = [], 0
    for im in images:
        own = []
        for c in range(len(im.components)):
            _, _, gh, gw = im.grid(c)
            own.append(at)
            at += gh * gw
        base.append(own)
    out = np.zeros((at, 64), np.int16)
    turns: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for im, own in zip(images, base):
        for s, turn in zip(im.scans, _schedule(tuple((tuple(s.components), s.lo, s.hi) for s in im.scans))):
            turns[turn][s.lo, s.hi, s.high, s.low, tuple(t[0] for t in s.tables) if not s.lo else s.tables[0][1]].append((im, own, s))
    for _, groups in sorted(turns.items()):
        for (lo, *_), members in groups.items():
            data: list[bytes] = []
            orders, places, counts = [], [], []
            for im, own, s in members:
                blocks, comps, unit = _scan_blocks(im.width, im.height, tuple(x[1:3] for x in im.components), tuple(s.components))
                orders.append(blocks + (own[s.components[0]] if unit == 1 else np.array(own)[comps]))
                if not lo:
                    places.append(_order(comps, tuple(s.components)))
                counts.append(_intervals(len(blocks), unit * s.restart or len(blocks)))
                if len(counts[-1]) != len(s.intervals):
                    raise ValueError("restart intervals are missing")
                data += s.intervals
            order, n = np.concatenate(orders), np.concatenate(counts)
            comps = np.concatenate(places) if not lo else None
            ends = np.cumsum(n)
            scan = members[0][2]
            for k in range(0, len(data), LANES):
                lanes, own = Lanes(data[k : k + LANES]), n[k : k + LANES]
                some = slice(int(ends[k] - n[k]), int(ends[min(k + LANES, len(n)) - 1]))
                if not lo:
                    place, comp = np.zeros((len(own), int(own.max())), np.int64), np.zeros((len(own), int(own.max())), np.int64)
                    inside = np.arange(place.shape[1]) < own[:, None]
                    place[inside], comp[inside] = order[some], comps[some]
                    _read_dc(lanes, own, place, comp, [] if scan.high else [lookup(t[0]) for t in scan.tables], out, scan)
                else:
                    (_read_ac_refine if scan.high else _read_ac_first)(lanes, own, np.cumsum(own) - own, order[some], lookup(scan.tables[0][1]), out, scan)
    for im, own in zip(images, base):
        im.coefficients = [out[o : o + im.grid(c)[2] * im.grid(c)[3]] for c, o in enumerate(own)]


def _idct_weights() -> np.ndarray:
    """64 x 64: from zigzag coefficients to row-major samples, times 2**13 and rounded to whole numbers."""
    x = np.arange(8)
    a = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) / 2
    a[:, 0] /= np.sqrt(2)
    w = np.einsum("yv,xu->yxvu", a, a).reshape(64, 64)
    return np.rint(w[:, ZIGZAG] * 8192).T


IDCT = _idct_weights()


def planes(images: list[Image]) -> list[list[np.ndarray]]:
    """Samples of each component of each image over its padded grid, 0 to 255; one product transforms all blocks."""
    blocks = [im.coefficients[c] * im.quantization[x[3]] for im in images for c, x in enumerate(im.components)]
    if not blocks:
        return []
    v = np.concatenate(blocks).astype(np.float64) @ IDCT  # whole numbers below 2**53: exact
    s = np.clip(np.floor((v + 4096) / 8192) + 128, 0, 255).astype(np.uint8)
    out, at = [], 0
    for im in images:
        own = []
        for c in range(len(im.components)):
            _, _, gh, gw = im.grid(c)
            own.append(s[at : at + gh * gw].reshape(gh, gw, 8, 8).swapaxes(1, 2).reshape(8 * gh, 8 * gw))
            at += gh * gw
        out.append(own)
    return out


def rgb(images: list[Image]) -> list[np.ndarray]:
    """height x width x 3 tensors, chroma repeated to full resolution; one component gives grey."""
    tensors = []
    for image, own in zip(images, planes(images)):
        hm, vm = max(x[1] for x in image.components), max(x[2] for x in image.components)
        full = [p.repeat(vm // v, axis=0).repeat(hm // h, axis=1)[: image.height, : image.width] for p, (_, h, v, _) in zip(own, image.components)]
        out = np.empty((image.height, image.width, 3), np.uint8)
        if len(full) < 3:
            out[:] = full[0][:, :, None]
        else:
            y, cb, cr = full[0].astype(np.int32) * 65536 + 32768, full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
            for k, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
                out[:, :, k] = np.clip(v >> 16, 0, 255)
        tensors.append(out)
    return tensors


def decode_many(files: list[bytes]) -> list[Image]:
    images = [parse(f) for f in files]
    read_coefficients(images)
    return images


def _flat(image: Image) -> np.ndarray:
    """All blocks of a 4:2:0 image, unit by unit."""
    x = Layout.of(image.width // 16, image.height // 16)
    flat = np.empty((6 * x.units, 64), np.int16)
    for order, own in zip(x.raster, image.coefficients):
        flat[order] = own
    return flat


def payload_of(image: Image) -> np.ndarray:
    """The payload bytes of an image that `write_many` made."""
    n = int(next(c for c in image.comments if c.startswith(b"payload "))[8:])
    return (_flat(image).reshape(-1)[:n] + 128).astype(np.uint8)


def feature(tensor: np.ndarray) -> str:
    """Height, width, and the sums of R, G and B over all pixels."""
    return f"{tensor.shape[0]}x{tensor.shape[1]}:" + ",".join(map(str, tensor.sum(axis=(0, 1), dtype=np.int64).tolist()))


# ---- DataFrames -----------------------------------------------------------------------------------------------------
def padded(data: np.ndarray) -> np.ndarray:
    n = max(64, -(-len(data) // 64) * 64)
    return np.concatenate((data, np.zeros(n - len(data), np.uint8)))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): each whole text's payload as a progressive JPEG; null and empty texts are 64 zero bytes.

    One row per row of `docs`, whatever its doc_id; an empty table gives none; other columns are not read.  A text is held
    whole by one worker.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(part.column("text"))
        files = write_many([padded(data[s:e]) for s, e in zip(off[:-1], off[1:])])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(rows, work, "doc_id long, n_bytes long, media binary")


def _tensors(files: list[bytes | None]) -> list[np.ndarray | None]:
    """The tensor of each file, None for a null or unreadable one; readable files are read side by side."""
    some = [i for i, f in enumerate(files) if f]
    out: list[np.ndarray | None] = [None] * len(files)
    try:
        for i, t in zip(some, rgb(decode_many([files[i] for i in some]))):
            out[i] = t
    except (ValueError, IndexError, KeyError):  # one of them is broken: each by itself
        if len(some) > 1:
            for i in some:
                out[i] = _tensors([files[i]])[0]
    return out


def tensors(media: DataFrame) -> DataFrame:
    """All columns of `media` and height, width, rgb (binary, height x width x 3): any progressive JPEG; null or unreadable media give nulls.

    Columns of `media` with those names are replaced.  Repeated rows repeat; an empty table gives none.
    """
    names = [c for c in media.columns if c not in ("height", "width", "rgb")]

    def run(batches):
        for b in batches:
            for part in slices(b, "media"):
                rows = _tensors(part.column("media").to_pylist())
                extra = [pa.array([None if r is None else r.shape[i] for r in rows], pa.int32()) for i in (0, 1)]
                extra.append(pa.array([None if r is None else r.tobytes() for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *extra], names=[*names, "height", "width", "rgb"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in names), "height int, width int, rgb binary"])
    return media.select(*names).mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb_sha256 string"


def digest(media: DataFrame, with_rgb: bool = False) -> DataFrame:
    """Reads what `store` wrote back: payload length and digests, the RGB tensor's height, width and digest, and a feature of it; with `with_rgb` the tensor too.

    One row per row of `media`, whatever its doc_id; an empty table gives none.
    """

    def run(batches):
        for b in batches:
            for part in slices(b, "media"):
                files = part.column("media").to_pylist()
                images = decode_many(files)
                rows = []
                for f, im, t in zip(files, images, rgb(images)):
                    p, raw = payload_of(im), t.tobytes()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(t), *t.shape[:2], hashlib.sha256(raw).hexdigest(), raw))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)][: len(types) - (not with_rgb)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *arrays], names=names)

    names = [x.split()[0] for x in DIGEST.split(", ")] + (["rgb"] if with_rgb else [])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST + (", rgb binary" if with_rgb else ""))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`store` of every whole text of `documents`, read back by `digest`."""
    return digest(store(documents(spark, sf_dir)))
