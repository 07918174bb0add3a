"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: its models start empty and its ids and frame are
checksummed. Its ids are cut into lanes, consecutive runs of ``LANE`` ids that
are coded side by side, one id of every lane per step, so that each step is a
handful of array operations; the models are the block's and learn from all
lanes after every step.

Prediction of the next id of a lane:

- order 0: counts of the block's ids so far, renewed every ``RENEW`` steps;
- order 1: the id that last followed the same id, with a confidence;
- order 2: the id that last followed the same two ids, with a confidence.

Both learn from every id. The three are mixed in one distribution: the order-0 counts plus extra mass on the
predicted ids. How much is learned: for each confidence, hits and misses so
far give the odds of the prediction. All arithmetic is on integers, so coder
and decoder agree on every machine. The range coder is carryless, with 64-bit
state, and emits 16 bits at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANE = 256
LANES = 4096
_LANE_BITS = LANES.bit_length() - 1
BLOCK = LANE * LANES
RENEW = 8
MAGIC = b"IDB1"

_U = np.uint64
_TOP, _BOT, _16, _48 = _U(1 << 48), _U(1 << 40), _U(16), _U(48)
_SLOTS = 1 << 16
_STEP = 24  # count added for an id seen
_ROOM = 2 * LANE + 8  # 16-bit words a lane can take: no id costs over 32 bits
_CONF = np.concatenate([np.arange(8) >> 1, np.minimum(np.arange(8) + 1, 7)]).astype(np.int32)  # next confidence: missed, hit


class _Model:
    """Models of one block over the places 0 .. alphabet - 1 of its distinct ids."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.freq = np.ones(alphabet, np.int64)
        self.cum = np.zeros(alphabet + 1, np.int64)
        self.slot = [np.zeros(alphabet, np.int32), np.zeros(_SLOTS, np.int32)]  # 8 times the id that followed, and its confidence
        self.tally = [np.tile([1, 0], 8), np.tile([1, 0], 8)]  # misses and hits by confidence
        self.key = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]
        self.seen: list[np.ndarray] = []
        self.step = 0

    def predict(self, rows: int) -> None:
        """The step's order-0 table and, for the first rows lanes, the ids
        predicted by orders 1 and 2 with their extra mass."""
        if self.step % RENEW == 0 or self.step < 4:
            if self.seen:
                self.freq += _STEP * np.bincount(np.concatenate(self.seen), minlength=self.alphabet)
                self.seen = []
            np.cumsum(self.freq, out=self.cum[1:])
        total = int(self.cum[-1])
        self.conf_now, self.guess, self.mass = [], [], []
        self.total = total
        for order in (0, 1):
            key = self.key[order] = self.key[order][:rows]
            t = self.tally[order].reshape(8, 2)
            odds = np.minimum((t[:, 1] << 8) // t[:, 0], 1 << 13)
            slot = self.slot[order].take(key)
            c = slot & 7
            self.conf_now.append(c)
            self.guess.append(slot >> 3)
            self.mass.append(((total * odds) >> 8).take(c))
            self.total = self.total + self.mass[-1]

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' shares of the total."""
        start, size = self.cum.take(x), self.freq.take(x)
        for p, m in zip(self.guess, self.mass, strict=True):
            start += m * (p < x)
            size += m * (p == x)
        return start.view(_U), size.view(_U)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose shares hold v."""
        (p, q), (m, n) = self.guess, self.mass
        swap = p > q
        for g, k in ((np.where(swap, q, p), np.where(swap, n, m)), (np.where(swap, p, q), np.where(swap, m, n))):
            last = self.cum.take(g + 1)
            v = np.where(v >= last, np.maximum(v - k, last - 1), v)
        v = np.sort(v << _LANE_BITS | np.arange(len(v)))  # with their lanes, several times faster than an argsort
        out = np.empty_like(v)
        out[v & (LANES - 1)] = np.searchsorted(self.cum, v >> _LANE_BITS, side="right") - 1
        return out

    def learn(self, x: np.ndarray) -> None:
        self.seen.append(x)
        small = x.astype(np.int32)
        for order in (0, 1):
            key, c, p = self.key[order], self.conf_now[order], self.guess[order]
            good = p == small
            self.tally[order] += np.bincount(2 * c + good, minlength=16)
            self.slot[order][key] = np.where(c < 2, small, p) << 3 | _CONF.take(c + 8 * good)
        self.key[1] = (self.key[0] * 40503 + x * 30011) & (_SLOTS - 1)
        self.key[0] = x
        self.step += 1


def _lanes(ids: int) -> int:
    return max(1, -(-ids // LANE))


def _settled(low, span):
    """Lanes whose top 16 bits are certain, ranges that straddle being cut."""
    same = (low ^ (low + span)) < _TOP
    small = span < _BOT
    if small.any():
        small &= ~same
        span[small] = (~low[small] + _U(1)) & (_BOT - _U(1))
        same |= small
    return same


def encode_block(ids: np.ndarray) -> bytes:
    """A frame that ``decode_block`` reads; at most BLOCK ids."""
    ids = np.asarray(ids, np.int64)
    n, lanes = len(ids), _lanes(len(ids))
    present = np.bincount(ids) > 0 if n else np.zeros(1, bool)
    place = np.cumsum(present) - 1
    table = np.zeros(lanes * LANE, np.int64)
    table[:n] = place[ids]
    steps = np.ascontiguousarray(table.reshape(lanes, LANE).T)
    model = _Model(max(1, int(present.sum())), lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    first = np.arange(lanes) * _ROOM
    out, at = np.zeros(lanes * _ROOM, np.uint16), first.copy()
    for t in range(min(LANE, n)):
        rows = lanes if t < n - (lanes - 1) * LANE else lanes - 1  # the last lane may end early
        x, lo = steps[t, :rows], low[:rows]
        model.predict(rows)
        start, size = model.interval(x)
        r = span[:rows] // model.total.view(_U)
        lo += r * start
        r *= size
        while (same := _settled(lo, r)).any():
            out[at[:rows]] = lo >> _48
            at[:rows] += same
            shift = same * _16
            lo <<= shift
            r <<= shift
        span[:rows] = r
        model.learn(x)
    for _ in range(4):
        out[at] = low >> _48
        at += 1
        low <<= _16
    used = at - first
    code = out.reshape(lanes, _ROOM)[np.arange(_ROOM) < used[:, None]].astype("<u2").tobytes()
    mask = zlib.compress(np.packbits(present).tobytes())
    body = struct.pack("<IIII", n, len(present), zlib.crc32(ids.astype("<u4").tobytes()), len(mask)) + mask + used.astype("<u2").tobytes() + code
    return MAGIC + struct.pack("<II", len(body), zlib.crc32(body)) + body


def decode_block(frame: bytes) -> np.ndarray:
    """The ids of one frame; a wrong checksum raises."""
    if frame[:4] != MAGIC:
        raise ValueError("no block of ids")
    length, crc = struct.unpack("<II", frame[4:12])
    body = frame[12 : 12 + length]
    if len(body) != length or zlib.crc32(body) != crc:
        raise ValueError("block is damaged")
    n, size, ids_crc, packed = struct.unpack("<IIII", body[:16])
    known = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(body[16 : 16 + packed]), np.uint8), count=size))
    body = body[16 + packed :]
    lanes = _lanes(n)
    used = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", -1, 2 * lanes).astype(_U), np.zeros(4, _U)])
    at = np.cumsum(used) - used
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _16) | words[at]
        at += 1
    model = _Model(max(1, len(known)), lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    steps = np.zeros((LANE, lanes), np.int64)
    for t in range(min(LANE, n)):
        rows = lanes if t < n - (lanes - 1) * LANE else lanes - 1
        lo, co = low[:rows], code[:rows]
        model.predict(rows)
        total = model.total.view(_U)
        r = span[:rows] // total
        x = model.find(np.minimum((co - lo) // r, total - _U(1)).view(np.int64))
        start, width = model.interval(x)
        lo += r * start
        r *= width
        while (same := _settled(lo, r)).any():
            shift = same * _16
            co <<= shift
            co |= np.where(same, words.take(at[:rows], mode="clip"), _U(0))
            at[:rows] += same
            lo <<= shift
            r <<= shift
        span[:rows] = r
        steps[t, :rows] = x
        model.learn(x)
    places = np.ascontiguousarray(steps.T).reshape(-1)[:n]
    ids = known[places] if n else np.empty(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids differ from their checksum")
    return ids.astype(np.uint32)


def frame_size(data, at: int) -> int:
    return 12 + struct.unpack_from("<I", data, at + 4)[0]
