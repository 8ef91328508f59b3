"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block of up to BLOCK ids stands alone: all its statistics start afresh, and a CRC-32 of its ids is
kept beside it. At each place three contexts predict the next id: the two ids before it (order 2), the
id before it (order 1), and the ids seen lately (order 0, one per low byte). The coder first says which
of them is right, the highest order that is, or none. The odds of the four answers are a mix of three
adaptive tables (by how reliable the order-2 and order-1 slots have been, and by the last answers), with
weights that follow which table has predicted best. After an order-0 answer the low byte follows, after
"none" the whole id.

The coder is a range coder over 48-bit intervals with 16-bit words. All blocks of a call move in
step, one id at a time, as columns of numpy arrays, so the memory is bounded by the number of blocks
of a call (LANES), and a block can be read without the others. The odds of four answers are four
16-bit fields of one 64-bit number: a table row is one look-up, a mix is a sum of products and the
cumulative odds are one multiplication, since no field reaches 2^16.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 2048, 2048
SLOTS = 512  # of each prediction table of a block
ORDER2, ORDER1, ORDER0, NONE = 0, 1, 2, 3
_U = np.uint64
_TOP, _LOW32, _LOW16 = _U(1 << 48), _U((1 << 32) - 1), _U(0xFFFF)
_EACH = _U(0x0001000100010001)
# One answer in 32 moves the odds: a field decays by its 32nd part and the answer gains 128, so a row
# sums to at most 4220, and twelve times that stays below 2^16.
_DECAY = _U(0x07FF07FF07FF07FF)
_START = _U(0x0400040004000400)
# Weights of the tables (first, second, third) by code: bit 0 first >= second, bit 1 first >= third, bit 2 second >= third.
_RANK = [[(not c & 1) + (not c & 2), (c & 1) + (not c & 4), bool(c & 2) + bool(c & 4)] for c in range(8)]
_WEIGHT = [np.array([(7, 3, 2)[min(2, r[k])] for r in _RANK], np.uint64) for k in range(3)]
_SHIFT = np.array([0, 16, 32, 48], np.uint64)
_GAIN = np.array([128 << s for s in (0, 16, 32, 48)], np.uint64)
_REST = np.array([0, 0, 8, 16], np.uint64)
_MASK = np.array([0, 0, 0xFF, 0xFFFF], np.uint64)
_M2, _M1 = _U(0x2F0B4C47), _U(0x9E3779B1)


class _Model:
    """State of ``lanes`` blocks, alike for writing and reading. A prediction slot is id << 3 | reliability."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.uint64)
        self.two, self.one = np.zeros(lanes * SLOTS, np.uint32), np.zeros(lanes * SLOTS, np.uint32)
        self.zero = np.zeros(lanes * 256, np.uint16)
        self.odds = [np.full(lanes * 16, _START, np.uint64) for _ in range(3)]
        self.merit = [np.zeros(lanes, np.int64) for _ in range(3)]
        self.before, self.last, self.answers = (np.zeros(lanes, np.uint64) for _ in range(3))

    def first(self, lanes: int) -> _Model:
        """The model of the first ``lanes`` blocks."""
        new = _Model.__new__(_Model)
        new.lane, new.two, new.one, new.zero = self.lane[:lanes], self.two[: lanes * SLOTS], self.one[: lanes * SLOTS], self.zero[: lanes * 256]
        new.odds = [o[: lanes * 16] for o in self.odds]
        new.merit = [m[:lanes].copy() for m in self.merit]
        new.before, new.last, new.answers = self.before[:lanes], self.last[:lanes], self.answers[:lanes]
        return new

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """Packed odds of the four answers, and packed cumulative odds."""
        part = self.last * _M1
        base = self.lane * _U(SLOTS)
        self.at2 = (base + (((self.before * _M2 + part) >> _U(7)) & _U(SLOTS - 1))).view(np.int64)
        self.at1 = (base + ((part >> _U(9)) & _U(SLOTS - 1))).view(np.int64)
        self.slot2, self.slot1 = self.two.take(self.at2), self.one.take(self.at1)
        self.guess2, self.guess1 = (self.slot2 >> 3).astype(np.uint64), (self.slot1 >> 3).astype(np.uint64)
        agree = (self.guess2 == self.guess1).astype(np.uint64) + (self.lane << _U(4))
        self.rows = [
            (agree + (self.slot2 & 7) * _U(2)).view(np.int64),
            (agree + (self.slot1 & 7) * _U(2)).view(np.int64),
            ((self.lane << _U(4)) + self.answers).view(np.int64),
        ]
        self.tables = [odds.take(row) for odds, row in zip(self.odds, self.rows)]
        a, b, c = self.merit
        code = (a >= b).view(np.uint8) + ((a >= c).view(np.uint8) << 1) + ((b >= c).view(np.uint8) << 2)
        mix = self.tables[0] * _WEIGHT[0].take(code)
        mix += self.tables[1] * _WEIGHT[1].take(code)
        mix += self.tables[2] * _WEIGHT[2].take(code)
        return mix, mix * _EACH

    def answer(self, ids: np.ndarray) -> np.ndarray:
        """Which prediction is right: the highest order that is."""
        zero = self.zero.take(((self.lane << _U(8)) + (ids & _U(255))).view(np.int64))
        miss2, miss1, miss0 = ids != self.guess2, ids != self.guess1, ids != zero
        return miss2.view(np.uint8) + (miss2 & miss1).view(np.uint8) + (miss2 & miss1 & miss0).view(np.uint8)

    def learn(self, ids: np.ndarray, answer: np.ndarray):
        shift, gain = _SHIFT.take(answer), _GAIN.take(answer)
        for k in range(3):
            t, m = self.tables[k], self.merit[k]
            hit = ((t >> shift) & _LOW16).view(np.int64)
            m += (hit - m) >> 3
            self.odds[k][self.rows[k]] = t - ((t >> _U(5)) & _DECAY) + gain
        fresh = ids.astype(np.uint32) << 3
        for table, at, slot, guess in ((self.two, self.at2, self.slot2, self.guess2), (self.one, self.at1, self.slot1, self.guess1)):
            sure = slot & 7
            kept = np.where(sure > 1, slot - sure + (sure >> 1), fresh)
            table[at] = np.where(guess == ids, slot + (sure < 7), kept)
        self.zero[((self.lane << _U(8)) + (ids & _U(255))).view(np.int64)] = ids
        self.answers = ((self.answers << _U(2)) + answer) & _U(15)
        self.before, self.last = self.last, ids


def _finish(low, flat, pos):
    for s in (32, 16, 0):
        flat[pos] = ((low >> _U(s)) & _LOW16).astype(np.uint32)
        pos = pos + 1
    return pos


def encode(ids: np.ndarray) -> tuple[list[bytes], list[int], list[int]]:
    """(payloads, sizes, checksums) of the blocks of a sequence of ids below 2^16, LANES blocks at a time."""
    most = BLOCK * LANES
    if len(ids) > most:
        parts = [encode(ids[at : at + most]) for at in range(0, len(ids), most)]
        return tuple(sum((p[k] for p in parts), []) for k in range(3))
    lanes = -(-len(ids) // BLOCK)
    sizes = np.full(lanes, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (lanes - 1)
    grid = np.zeros(lanes * BLOCK, np.uint64)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, BLOCK)
    steps = np.ascontiguousarray(grid.T)
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _TOP, np.uint64)
    width = 2 * BLOCK + 6
    flat = np.zeros(lanes * width, np.uint32)
    pos = np.arange(lanes) * width + 1  # the first word takes a carry
    tail = None

    def renew():
        nonlocal pos
        over = np.flatnonzero(low >= _TOP)
        if len(over):
            flat[pos[over] - 1] += 1
            low[over] -= _TOP
        shift = np.flatnonzero(span <= _LOW32)
        if len(shift):
            x = low[shift]
            flat[pos[shift]] = x >> _U(32)
            low[shift] = (x & _LOW32) << _U(16)
            span[shift] <<= _U(16)
            pos[shift] += 1

    for step in range(int(sizes[0])):
        if step == sizes[-1]:  # only the last block may be shorter
            tail = _finish(low[-1:], flat, pos[-1:])
            low, span, pos, model = low[:-1].copy(), span[:-1].copy(), pos[:-1].copy(), model.first(lanes - 1)
        now = steps[step, : len(low)]
        odds, upto = model.look()
        answer = model.answer(now)
        shift = _SHIFT.take(answer)
        size = (odds >> shift) & _LOW16
        part = span // (upto >> _U(48))
        low += (((upto >> shift) & _LOW16) - size) * part
        span = size * part
        renew()
        span >>= _REST.take(answer)
        low += (now & _MASK.take(answer)) * span
        renew()
        model.learn(now, answer)
    ends = _finish(low, flat, pos)
    if tail is not None:
        ends = np.concatenate([ends, tail])
    out = flat.reshape(lanes, width)
    for k in range(int(max(ends - np.arange(lanes) * width)) - 1, 0, -1):
        carry = out[:, k] >> 16
        out[:, k] &= 0xFFFF
        out[:, k - 1] += carry
    payloads = [out[i, : ends[i] - i * width].astype("<u2").tobytes() for i in range(lanes)]
    sums = [zlib.crc32(grid[i, : sizes[i]].astype("<u4").tobytes()) for i in range(lanes)]
    return payloads, sizes.tolist(), sums


def decode(payloads: list[bytes], sizes: list[int], sums: list[int]) -> np.ndarray:
    """The ids of consecutive blocks, LANES at a time; raises ValueError where a checksum differs."""
    if len(payloads) > LANES:
        return np.concatenate([decode(payloads[a : a + LANES], sizes[a : a + LANES], sums[a : a + LANES]) for a in range(0, len(payloads), LANES)])
    lanes = len(payloads)
    width = max(len(p) for p in payloads) // 2 + 2
    words = np.zeros((lanes, width), np.uint64)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    flat = words.reshape(-1)
    pos = np.arange(lanes) * width + 4
    code = (words[:, 0] << _U(48)) + (words[:, 1] << _U(32)) + (words[:, 2] << _U(16)) + words[:, 3]
    span = np.full(lanes, _TOP, np.uint64)
    model = _Model(lanes)
    grid = np.zeros((max(sizes), lanes), np.uint32)

    def renew():
        shift = np.flatnonzero(span <= _LOW32)
        if len(shift):
            p = pos[shift]
            code[shift] = (code[shift] << _U(16)) | flat[p]
            span[shift] <<= _U(16)
            pos[shift] = p + 1

    for step in range(sizes[0]):
        if step == sizes[-1]:
            code, span, pos, model = code[:-1].copy(), span[:-1].copy(), pos[:-1].copy(), model.first(lanes - 1)
        odds, upto = model.look()
        total = upto >> _U(48)
        part = span // total
        at = np.minimum(code // part, total - _U(1))
        answer = (at >= (upto & _LOW16)).view(np.uint8) + (at >= ((upto >> _U(16)) & _LOW16)).view(np.uint8)
        answer += (at >= ((upto >> _U(32)) & _LOW16)).view(np.uint8)
        shift = _SHIFT.take(answer)
        size = (odds >> shift) & _LOW16
        code -= (((upto >> shift) & _LOW16) - size) * part
        span = size * part
        renew()
        span >>= _REST.take(answer)
        value = np.minimum(code // span, _MASK.take(answer))
        code -= value * span
        renew()
        ids = value
        zero = np.flatnonzero(answer == ORDER0)
        ids[zero] = model.zero.take(((model.lane[zero] << _U(8)) + value[zero]).view(np.int64))
        ids = np.where(answer == ORDER2, model.guess2, np.where(answer == ORDER1, model.guess1, ids))
        model.learn(ids, answer)
        grid[step, : len(ids)] = ids
    blocks = [np.ascontiguousarray(grid[: sizes[i], i], dtype="<u4") for i in range(lanes)]
    for block, want in zip(blocks, sums):
        if zlib.crc32(block.tobytes()) != want:
            raise ValueError("a block's checksum differs")
    return np.concatenate(blocks)
