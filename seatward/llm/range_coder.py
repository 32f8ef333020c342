"""A range coder for token ids with mixed predictions of order 0 to 2, in blocks that are reset and checksummed each for itself.

The ids that followed the last one and the last two are remembered with a confidence. The better of the two is the candidate, and
three adaptive estimates (by the confidence of order 2, that of order 1, and the candidate's own frequency) of whether it comes next are
mixed in the logistic domain with weights learned on the way. Where it does not come, the other prediction is tried; then the id is coded by
adaptive frequencies: the block's most frequent ids one by one, the rest as classes of neighbouring ids with an offset.

Blocks know nothing of each other, so numpy codes many side by side, one id of each at a time. All arithmetic is on integers, and the
same step runs in both directions.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8_192
LANES = 1_280
SLOT_BITS = 11
SLOTS = 1 << SLOT_BITS
NAMED = 192
IDS = 1 << 16
MAGIC = b"TKCM\x01"
# Steps between two renewals of the cumulative frequencies; weight of one occurrence; largest total.
RENEW, GAIN, TOP_TOTAL = 16, 24, 1 << 15

# Classes of ids that are not named: 4 of 128 ids, 28 of 128, 30 of 2048.
_BASE = np.concatenate([np.arange(0, 4096, 128), np.arange(4096, IDS, 2048)]).astype(np.int64)
_BITS = np.where(_BASE < 4096, 7, 11).astype(np.uint64)
_CLASS = (np.searchsorted(_BASE, np.arange(IDS), "right") - 1 + NAMED).astype(np.uint8)
SYMBOLS = 256

_x = (np.arange(4096) + 0.5) / 4096
STRETCH = np.clip(np.rint(256 * np.log(_x / (1 - _x))), -2047, 2047).astype(np.int32)
# The mixed value of three bounded weights and leans stays within the table.
_REACH = 3 * (2047 << 1) + 8
SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-np.clip(np.arange(-_REACH, _REACH) / 256, -40, 40)))), 1, 4095).astype(np.int32)
LEVEL = np.minimum(np.ceil(2 * np.log2(np.arange(TOP_TOTAL * 2) + 1)), 31).astype(np.int32)
_HALF = np.uint64(1 << 32)
_LOW32 = np.uint64((1 << 32) - 1)
_S16, _S48 = np.uint64(16), np.uint64(48)


class _Lanes:
    """Models and coder state of blocks side by side, longest first, so that the blocks still running are a leading slice.

    ``words`` is None where ids are coded, and the code to read where they are decoded.
    """

    def __init__(self, named: list[np.ndarray], streams: list[np.ndarray] | None = None):
        n = len(named)
        lane = np.arange(n, dtype=np.int32)
        # A slot holds the id that followed, its symbol and how sure that is: 16, 8 and 4 bits.
        self.slot0 = np.stack([lane * SLOTS, (lane + n) * SLOTS])
        self.slots = np.full(2 * n * SLOTS, int(_CLASS[0]) << 16, np.int32)
        self.small0 = np.stack([lane * 32, (lane + n) * 32, (lane + 2 * n) * 32])
        self.sym0, self.sum0, self.ids0 = lane * SYMBOLS, lane * (SYMBOLS + 1), lane * NAMED
        self.ids = np.zeros(n * NAMED, np.int32)
        for i, ids in enumerate(named):
            self.ids[i * NAMED : i * NAMED + len(ids)] = ids
            if len(zero := np.flatnonzero(ids == 0)):
                # Slots start with id 0, which has a symbol of its own here.
                for order in (i, i + n):
                    self.slots[order * SLOTS : (order + 1) * SLOTS] = int(zero[0]) << 16
        self.count = np.full((n, SYMBOLS), 2, np.int32)
        self.count_flat = self.count.reshape(-1)
        self.sum = np.zeros((n, SYMBOLS + 1), np.int32)
        self.sum_flat = self.sum.reshape(-1)
        self.chance = np.full(3 * n * 32, 1 << 15, np.int32)
        self.other = np.full(n * 16, 1 << 15, np.int32)
        self.weight = np.full((3, n), 24_000, np.int32)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, np.uint64((1 << 64) - 1), np.uint64)
        self.last, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.out: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.words = None
        if streams is not None:
            # A spoilt block may ask for more words than it has: it reads zeros of its own.
            begin = np.cumsum([0] + [len(s) + 8 for s in streams])
            self.words = np.zeros(int(begin[-1]) + 8, np.uint64)
            for b, s in zip(begin, streams, strict=False):
                self.words[b : b + len(s)] = s
            self.at, self.end = begin[:-1].copy(), begin[1:] - 1
            self.code = np.zeros(n, np.uint64)
            for _ in range(4):
                self.code = (self.code << _S16) | self._next(slice(None))

    def _next(self, at) -> np.ndarray:
        got = self.words[np.minimum(self.at[at], self.end[at])]
        self.at[at] += 1
        return got

    def renew(self, k: int) -> None:
        count = self.count[:k]
        np.cumsum(count, axis=1, out=self.sum[:k, 1:])
        heavy = np.flatnonzero(self.sum[:k, SYMBOLS] > TOP_TOTAL)
        if len(heavy):
            count[heavy] = (count[heavy] >> 1) + 1
            self.sum[heavy, 1:] = np.cumsum(count[heavy], axis=1)

    def shift(self, at) -> None:
        """Move 16 bits where the range is short, of the lanes ``at``; a range across a border is cut there."""
        short = self.range[at] < _HALF
        if not short.any():
            return
        at = np.flatnonzero(short) if isinstance(at, slice) else at[short]
        while len(at):
            low, rng = self.low[at], self.range[at]
            across = ((low ^ (low + rng - np.uint64(1))) >> _S48) != 0
            if across.any():
                rng = np.where(across, (~low + np.uint64(1)) & _LOW32, rng)
            if self.words is None:
                self.out.append((low >> _S48).astype(np.uint16))
                self.places.append(at)
            else:
                self.code[at] = (self.code[at] << _S16) | self._next(at)
                rng = np.maximum(rng, np.uint64(1))
            rng = rng << _S16
            self.low[at], self.range[at] = low << _S16, rng
            at = at[rng < _HALF]

    def bit(self, at, p: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        """Code or read one decision per lane of ``at``; ``p`` is its chance in 4096."""
        low, rng = self.low[at], self.range[at]
        bound = (rng >> _S16) * (p.astype(np.uint64) << np.uint64(4))
        if value is None:
            value = self.code[at] - low < bound
        self.low[at] = np.where(value, low, low + bound)
        self.range[at] = np.where(value, bound, rng - bound)
        self.shift(at)
        return value

    def by_frequency(self, at: np.ndarray, ids: np.ndarray | None, symbol: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Code or read the ids of the lanes ``at`` by the frequencies of symbols; returns ids and symbols."""
        sum0 = self.sum0[at]
        each = self.range[at] // self.sum_flat[sum0 + SYMBOLS].astype(np.uint64)
        if symbol is None:
            value = np.minimum((self.code[at] - self.low[at]) // np.maximum(each, np.uint64(1)), np.uint64(TOP_TOTAL * 2)).astype(np.int32)
            value = np.minimum(value, self.sum_flat[sum0 + SYMBOLS] - 1)[:, None]
            # Sixteens first, then within one.
            high = (self.sum[at, 16:SYMBOLS:16] <= value).sum(axis=1, dtype=np.int32) * 16
            near = self.sum_flat[(sum0 + high)[:, None] + np.arange(1, 16, dtype=np.int32)]
            symbol = high + (near <= value).sum(axis=1, dtype=np.int32)
        first = self.sum_flat[sum0 + symbol]
        self.low[at] += each * first.astype(np.uint64)
        self.range[at] = each * (self.sum_flat[sum0 + symbol + 1] - first).astype(np.uint64)
        self.shift(at)
        decoding = ids is None
        if decoding:
            ids = self.ids[self.ids0[at] + np.minimum(symbol, NAMED - 1)]
        plain = np.flatnonzero(symbol >= NAMED)
        if len(plain):
            lanes, kind = at[plain], np.minimum(symbol[plain] - NAMED, len(_BASE) - 1)
            each = self.range[lanes] >> _BITS[kind]
            if decoding:
                most = (np.uint64(1) << _BITS[kind]) - np.uint64(1)
                off = np.minimum((self.code[lanes] - self.low[lanes]) // np.maximum(each, np.uint64(1)), most)
                ids[plain] = np.minimum(_BASE[kind] + off.astype(np.int64), IDS - 1)
            else:
                off = (ids[plain] - _BASE[kind]).astype(np.uint64)
            self.low[lanes] += each * off
            self.range[lanes] = each
            self.shift(lanes)
        return ids, symbol

    def step(self, k: int, ids: np.ndarray | None, symbols: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``k`` lanes, or read it where ``ids`` is None; then learn it."""
        every = slice(0, k)
        last, last2 = self.last[:k], self.last2[:k]
        at = np.empty((2, k), np.int64)
        at[0] = (last * 40503 & 0xFFFF) >> (16 - SLOT_BITS)
        at[1] = ((last * 2654435761 + last2 * 2246822519) & 0xFFFFFFFF) >> (32 - SLOT_BITS)
        at += self.slot0[:, :k]
        slot = self.slots[at]
        sure = slot >> 24
        best = np.where(sure[1] > 0, slot[1], slot[0])
        candidate = best & 0xFFFF
        same = (slot[0] & 0xFFFF) == candidate
        j = np.empty((3, k), np.int32)
        j[:2] = sure[::-1] * 2 + same
        j[2] = LEVEL[self.count_flat[self.sym0[:k] + ((best >> 16) & 0xFF)]]
        j += self.small0[:, :k]
        chance = self.chance[j]
        lean = STRETCH[chance >> 4]
        mixed = (self.weight[:, :k] * lean).sum(axis=0, dtype=np.int32) >> 16
        p = SQUASH[mixed + _REACH]
        hit = self.bit(every, p, None if ids is None else candidate == ids)

        goal = hit * np.int32(65535)
        self.chance[j] = chance + ((goal - chance) >> 5)
        slope = ((goal >> 4) - p) * np.int32(6)
        weight = self.weight[:, :k]
        weight += (lean * slope) >> 10
        np.minimum(weight, 1 << 17, out=weight)
        np.maximum(weight, -(1 << 17), out=weight)

        decoding = ids is None
        if decoding:
            ids, symbols = candidate.copy(), (best >> 16) & 0xFF
        miss = ~hit
        # The other prediction, where there is one.
        second = np.flatnonzero(miss & ~same)
        if len(second):
            other = self.small0[0][second] // 2 + sure[0][second]
            old = self.other[other]
            guess = slot[0][second]
            got = self.bit(second, np.maximum(old >> 4, 1), None if decoding else (guess & 0xFFFF) == ids[second])
            self.other[other] = old + ((got * np.int32(65535) - old) >> 5)
            found = second[got]
            miss[found] = False
            if decoding:
                ids[found], symbols[found] = guess[got] & 0xFFFF, (guess[got] >> 16) & 0xFF
        rest = np.flatnonzero(miss)
        if len(rest):
            new = self.by_frequency(rest, None if decoding else ids[rest], None if decoding else symbols[rest])
            if decoding:
                ids[rest], symbols[rest] = new

        right = (slot & 0xFFFF) == ids
        # A sure prediction survives a miss with half its confidence.
        replace = ~right & (sure < 2)
        kept = np.where(right, np.minimum(sure + 1, 15), sure >> 1)
        self.slots[at] = np.where(replace, ids | (symbols << 16) | (1 << 24), (slot & 0xFFFFFF) | (kept << 24))
        self.count_flat[self.sym0[:k] + symbols] += GAIN
        self.last2[:k] = last
        self.last[:k] = ids
        return ids


def _running(lengths: np.ndarray, step: int) -> int:
    return int(np.searchsorted(-lengths, -step, "left"))


def _named(ids: np.ndarray) -> np.ndarray:
    counts = np.bincount(ids, minlength=1)
    most = np.argsort(-counts, kind="stable")[:NAMED]
    return most[counts[most] >= 4]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 2^16) as bytes: magic, number of ids, CRC-32 of the ids as 32-bit little-endian, named ids, code."""
    return [b for start in range(0, len(blocks), LANES) for b in _encode(blocks[start : start + LANES])]


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order], np.int64)
    n, most = len(order), int(lengths[0])
    table, symbols, named = np.zeros((most, n), np.uint16), np.zeros((most, n), np.uint8), []
    for lane, i in enumerate(order):
        ids = blocks[i]
        if len(ids) and (ids.min() < 0 or ids.max() >= IDS):
            raise ValueError("ids must be below 65536")
        named.append(_named(ids))
        of = _CLASS.copy()
        of[named[-1]] = np.arange(len(named[-1]))
        table[: len(ids), lane], symbols[: len(ids), lane] = ids, of[ids]
    lanes = _Lanes(named)
    for step in range(most):
        k = _running(lengths, step)
        if step % RENEW == 0:
            lanes.renew(k)
        lanes.step(k, table[step, :k].astype(np.int32), symbols[step, :k].astype(np.int32))
    for _ in range(4):
        lanes.out.append((lanes.low >> _S48).astype(np.uint16))
        lanes.places.append(np.arange(n))
        lanes.low = lanes.low << _S16
    place = np.concatenate(lanes.places)
    by_lane = np.argsort(place, kind="stable")
    code = np.concatenate(lanes.out)[by_lane]
    edges = np.searchsorted(place[by_lane], np.arange(n + 1))
    result: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
        head = MAGIC + struct.pack("<IIB", len(blocks[i]), crc, len(named[lane])) + named[lane].astype("<u2").tobytes()
        result[i] = head + code[edges[lane] : edges[lane + 1]].astype("<u2").tobytes()
    return result


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is not one, or whose ids do not fit the checksum, raises ``ValueError``."""
    return [b for start in range(0, len(blocks), LANES) for b in _decode(blocks[start : start + LANES])]


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    heads = []
    for b in blocks:
        if b[:5] != MAGIC or len(b) < 14:
            raise ValueError("not a block of token ids")
        size, crc, names = struct.unpack("<IIB", b[5:14])
        heads.append((size, crc, np.frombuffer(b, "<u2", names, 14).astype(np.int64), 14 + 2 * names))
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order], np.int64)
    most = int(lengths[0])
    lanes = _Lanes([heads[i][2] for i in order], [np.frombuffer(blocks[i], "<u2", offset=heads[i][3]) for i in order])
    table = np.zeros((most, len(order)), np.uint16)
    for step in range(most):
        k = _running(lengths, step)
        if step % RENEW == 0:
            lanes.renew(k)
        table[step, :k] = lanes.step(k, None, None)
    result: list = [None] * len(order)
    for lane, i in enumerate(order):
        ids = table[: lengths[lane], lane].astype(np.int32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][1]:
            raise ValueError("a block of token ids does not fit its checksum")
        result[i] = ids
    return result
