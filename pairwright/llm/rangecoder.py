"""Adaptive context-mixing range coder for token ids, many blocks at once.

A block is up to ``BLOCK`` ids below 65,536 and starts from a model that knows
only the *prior* of its batch (the frequencies of all the batch's ids, which
are kept beside the blocks), so it can be decoded alone.  For the next id there
are three predictions: the id
that last followed the last two ids (order 2), the one that last followed the
last id (order 1), and the block's majority candidate (order 0).  Adaptive
counts, kept apart by how often the order-2 and order-1 predictions were right
of late, mix them with the prior's order-0 distribution into one
alphabet (right at order 2, 1, 0, or the prior, by which the id then follows);
a carry-less range coder with 48-bit state writes 16-bit words.

The model of all blocks of a call is held in arrays and every step codes one
id of every block, so numpy does the work.  Quotients are taken in double
precision, which is exact here: dividends stay below 2**48.

Block format (little-endian): magic ``CMR2``, number of ids (u32), crc32 of the
ids as u32 (u32), number of words (u32), words (u16 each).  Prior: zlib of the
differences of its ids (u16 each) and their frequencies in eighths of a
power of two (u8 each).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 2048, 4096
_SLOTS = 1024
_SYMBOLS = 4  # order 2, order 1, order 0, prior
_START = np.array([2, 2, 2, 18], np.uint16)
_U = np.uint64
_STEP, _FULL = _U(24), 6000
_STATE, _LEAST = 1 << 48, 1 << 32  # range of the state; below _LEAST a word leaves
_MOST = 1 << 20  # sum of a prior's frequencies, at most
_EIGHTHS = np.array([max(1, round(2 ** (q / 8))) for q in range(161)], np.int64)
_SUMS, _FIELD = _U(0x0001000100010001), _U(0xFFFF)
_PLACE_A, _PLACE_B = np.int32(0x6A53), np.int32(0x9E5D)
MAGIC = b"CMR2"


class Prior:
    """Frequencies of the ids of a batch, as they are kept; ids that do not occur have none."""

    def __init__(self, ids: np.ndarray, steps: np.ndarray):
        self.ids, self.steps = ids, steps
        own = _EIGHTHS[steps]
        self.upto = np.cumsum(own)
        self.total = int(self.upto[-1]) if len(own) else 1
        self.freq, self.start = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.freq[ids], self.start[ids] = own, self.upto - own
        self.at: np.ndarray | None = None

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Prior:
        counts = np.zeros(1 << 16, np.int64)
        for x in parts:
            counts += np.bincount(x, minlength=1 << 16)
        ids = np.flatnonzero(counts)
        scale = counts[ids] * min(1.0, 0.9 * (_MOST - len(ids)) / max(1, counts.sum()))
        return cls(ids, np.clip(np.rint(8 * np.log2(np.maximum(scale, 1.0))), 0, 160).astype(np.int64))

    def dump(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u2").tobytes() + self.steps.astype(np.uint8).tobytes(), 9)

    @classmethod
    def load(cls, raw: bytes) -> Prior:
        data = zlib.decompress(raw)
        n = len(data) // 3
        return cls(np.cumsum(np.frombuffer(data, "<u2", n).astype(np.int64)), np.frombuffer(data, np.uint8, offset=2 * n).astype(np.int64))

    def find(self, at: np.ndarray) -> np.ndarray:
        if self.at is None:
            self.at = np.repeat(self.ids, _EIGHTHS[self.steps]).astype(np.int32)  # one a frequency, _MOST at most or so
        return self.at.take(at, mode="clip")  # a damaged block may ask for places before the first


class _Model:
    """The counts of a context are four 16-bit fields of one uint64: a product with ``_SUMS`` gives their running sums."""

    def __init__(self, lanes: int):
        self.two = np.zeros(lanes * _SLOTS, np.int32)  # prediction << 2 | confidence
        self.one = np.zeros(lanes * _SLOTS, np.int32)
        self.major = np.zeros(lanes, np.int32)
        self.votes = np.zeros(lanes, np.int32)
        self.counts = np.full(lanes * 16, sum(int(n) << 16 * i for i, n in enumerate(_START)), np.uint64)
        self.base = np.arange(lanes, dtype=np.int64) * _SLOTS
        self.ctx = np.arange(lanes, dtype=np.int64) * 16
        self.a1 = np.zeros(lanes, np.int32)  # share of the id before the last in the place of order 2
        self.b = np.zeros(lanes, np.int32)

    def predict(self, k: int) -> np.ndarray:
        """Predictions for the first k lanes; the sums of their counts."""
        b = self.b[:k]
        b1 = b * _PLACE_B  # wraps; the low 15 bits count
        self.at2 = ((self.a1[:k] + b1) >> 4 & (_SLOTS - 1)) + self.base[:k]
        self.at1 = (b1 >> 5 & (_SLOTS - 1)) + self.base[:k]
        self.e2, self.e1 = self.two.take(self.at2), self.one.take(self.at1)
        self.p2, self.p1, self.p0 = self.e2 >> 2, self.e1 >> 2, self.major[:k]
        self.row = ((self.e2 & 3) << 2 | (self.e1 & 3)) + self.ctx[:k]
        self.own = self.counts.take(self.row)
        self.cum = self.own * _SUMS
        return (self.cum >> _U(48)).view(np.int64)

    def interval(self, sym: np.ndarray):
        """Start and width of the symbols' intervals."""
        self.shift = (sym << 4).view(np.uint64)
        f = self.own >> self.shift & _FIELD
        return ((self.cum >> self.shift & _FIELD) - f).view(np.int64), f.view(np.int64)

    def symbols(self, target: np.ndarray) -> np.ndarray:
        """The symbols in whose intervals ``target`` lies."""
        sym = np.zeros(len(target), np.int64)
        for i in range(_SYMBOLS - 1):
            sym += (self.cum >> _U(16 * i) & _FIELD).view(np.int64) <= target
        return sym

    def update(self, k: int, x: np.ndarray, total: np.ndarray) -> None:
        x4 = x << 2
        most = x4 | 3
        for table, at, e in ((self.two, self.at2, self.e2), (self.one, self.at1, self.e1)):
            table[at] = np.where((e ^ x4) < 4, np.minimum(e + 1, most), x4)
        votes = self.votes[:k] + ((self.p0 == x).view(np.int8) * np.int8(2) - np.int8(1))
        np.copyto(self.major[:k], x, where=votes < 0)
        np.abs(votes, out=self.votes[:k])
        self.counts[self.row] = self.own + (_STEP << self.shift)
        full = np.flatnonzero(total > _FULL)
        if len(full):
            rows = self.row[full]
            self.counts[rows] = ((self.counts[rows].view(np.uint16) + np.uint16(1)) >> 1).view(np.uint64)
        np.multiply(self.b[:k], _PLACE_A, out=self.a1[:k])
        self.b[:k] = x


def _renew(low, rng, k, word) -> None:
    """Renormalises the first k lanes; ``word(lanes, top words)`` is called for the words that leave."""
    lanes = np.flatnonzero(rng[:k] < _LEAST)
    while len(lanes):
        lo, r = low.take(lanes), rng.take(lanes)
        r = np.where((lo ^ (lo + r)) < _LEAST, r, -lo & (_LEAST - 1))
        word(lanes, lo >> 32)
        low[lanes], rng[lanes] = (lo << 16) & (_STATE - 1), r << 16
        lanes = lanes[(r << 16) < _LEAST]


def _live(sizes: np.ndarray, steps: int) -> np.ndarray:
    """How many lanes (in descending order of size) have an id at each step."""
    return len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), side="right")


def encode_blocks(blocks: list[np.ndarray], prior: Prior) -> list[bytes]:
    """The coded blocks; ``prior`` holds all their ids (``Prior.of(blocks)``)."""
    lanes = len(blocks)
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    ids = np.zeros((lanes, steps), np.uint16)
    for j, i in enumerate(order):
        ids[j, :sizes[i]] = blocks[i]
    ids = np.ascontiguousarray(ids.T)
    model = _Model(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _STATE - 1, np.int64)
    width = 2 * steps + 16
    out, pos = np.zeros(lanes * width, np.uint16), np.arange(lanes, dtype=np.int64) * width

    def put(which, words):
        at = pos.take(which)
        out[at] = words
        pos[which] = at + 1

    for t, k in enumerate(_live(sizes, steps).tolist()):
        x = ids[t, :k].astype(np.int32)
        total = model.predict(k)
        sym = ((model.p0 != x).view(np.int8) + np.int8(1)) * (model.p1 != x)  # 0, 1, 2: right at order 1, 0, not at all
        sym = ((sym + np.int8(1)) * (model.p2 != x)).astype(np.int64)
        c, f = model.interval(sym)
        r = (rng[:k] / total).astype(np.int64)
        low[:k], rng[:k] = low[:k] + r * c, r * f
        _renew(low, rng, k, put)
        rest = np.flatnonzero(sym == 3)
        if len(rest):
            own = x.take(rest)
            r = (rng.take(rest) / prior.total).astype(np.int64)
            low[rest] += r * prior.start.take(own)
            rng[rest] = r * prior.freq.take(own)
            _renew(low, rng, k, put)
        model.update(k, x, total)
    for _ in range(3):
        put(np.arange(lanes), low >> 32)
        low = (low << 16) & (_STATE - 1)
    coded: list[bytes] = [b""] * lanes
    for j, i in enumerate(order):
        raw = np.asarray(blocks[i], dtype="<u4").tobytes()
        words = out[j * width:pos[j]]
        coded[i] = MAGIC + struct.pack("<III", len(blocks[i]), zlib.crc32(raw), len(words)) + words.astype("<u2").tobytes()
    return coded


def decode_blocks(coded: list[bytes], prior: Prior) -> list[np.ndarray]:
    """The ids of each block; ValueError if a block is damaged."""
    heads = []
    for raw in coded:
        if raw[:4] != MAGIC or len(raw) < 16:
            raise ValueError("not a block")
        n, crc, words = struct.unpack("<III", raw[4:16])
        if len(raw) != 16 + 2 * words:
            raise ValueError("a block is cut short")
        heads.append((n, crc, words))
    lanes = len(coded)
    sizes = np.array([h[0] for h in heads], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    width = max((h[2] for h in heads), default=0) + 2 * steps + 8  # a damaged block may ask for more than it has
    data = np.zeros((lanes, width), np.uint16)
    for j, i in enumerate(order):
        data[j, :heads[i][2]] = np.frombuffer(coded[i], "<u2", offset=16)
    model = _Model(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _STATE - 1, np.int64)
    code, pos = np.zeros(lanes, np.int64), np.arange(lanes, dtype=np.int64) * width + 3
    for i in range(3):
        code = (code << 16) | data[:, i]
    data = data.reshape(-1)
    ids = np.zeros((steps, lanes), np.uint16)

    def pull(which, _):
        at = pos.take(which)
        code[which] = ((code.take(which) << 16) & (_STATE - 1)) | data.take(at)
        pos[which] = at + 1

    for t, k in enumerate(_live(sizes, steps).tolist()):
        total = model.predict(k)
        r = (rng[:k] / total).astype(np.int64)
        sym = model.symbols(np.minimum(((code[:k] - low[:k]) / r).astype(np.int64), total - 1))
        c, f = model.interval(sym)
        low[:k], rng[:k] = low[:k] + r * c, r * f
        x = np.where(sym == 0, model.p2, np.where(sym == 1, model.p1, model.p0))
        _renew(low, rng, k, pull)
        rest = np.flatnonzero(sym == 3)
        if len(rest):
            r = (rng.take(rest) / prior.total).astype(np.int64)
            own = prior.find(np.minimum(((code.take(rest) - low.take(rest)) / r).astype(np.int64), prior.total - 1))
            x[rest] = own
            low[rest] += r * prior.start.take(own)
            rng[rest] = r * prior.freq.take(own)
            _renew(low, rng, k, pull)
        ids[t, :k] = x
        model.update(k, x, total)
    ids = np.ascontiguousarray(ids.T)
    out: list = [None] * lanes
    for j, i in enumerate(order):
        n, crc, _ = heads[i]
        own = ids[j, :n].astype("<u4")
        if zlib.crc32(own.tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
        out[i] = own
    return out
