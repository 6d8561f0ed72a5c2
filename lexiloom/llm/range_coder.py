"""An adaptive context-mixing range coder for blocks of token ids.

A block is coded by up to LANES range coders side by side, each over its own stretch of the block, that share one
adaptive model; numpy handles one id of every lane at a step, and the model learns from the step before the next.

*Model.* Order 2 and order 1 each predict one id from the ids before it (the id last seen there, with a confidence
that grows while it holds). Whether the prediction comes true is coded with a probability that mixes all three orders:
it is learned per joint context of the confidence of order 2, the confidence of order 1, whether the two agree, and how
frequent the predicted id is by order 0. If it doesn't, the id is coded by the order-0 adaptive frequencies of the
whole alphabet. All of it is integer arithmetic, so any machine decodes what another has encoded.

*Coder.* 64-bit low and range, 32-bit words out, carries propagated at once. A block resets everything and carries a
CRC-32 of its payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 8192
LEAST_STEPS = 128
HEAD = struct.Struct("<4sIIIII")
MAGIC = b"LXR1"
U = np.uint64
_BOTTOM = U(1 << 32)
_S32, _S16 = U(32), U(16)
_STEP = 24  # what an occurrence adds to an id's frequency, which starts at 1
_SLOTS = 1 << 18


class _Model:
    def __init__(self, vocab: int):
        self.vocab = vocab
        self.freq = np.ones(vocab, np.int64)
        self.cum = np.zeros(vocab + 1, np.int64)
        self.guess1, self.sure1 = np.zeros(vocab, np.int32), np.zeros(vocab, np.int8)
        self.guess2, self.sure2 = np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int8)
        self.hit, self.all = np.full(1024, 1, np.int64), np.full(1024, 4, np.int64)
        self.refresh()

    def refresh(self):
        np.cumsum(self.freq, out=self.cum[1:])
        self.chance = np.clip(self.hit * 65536 // self.all, 48, 65536 - 48).astype(np.uint64)

    def predict(self, one, two):
        """(predicted id, context, slot of order 2) after ids one (last) and two (before it)."""
        slot = ((two * 0x9E3779B1 + one * 0x85EBCA6B) >> 7) & (_SLOTS - 1)
        a, ca, b, cb = self.guess2[slot], self.sure2[slot], self.guess1[one], self.sure1[one]
        guess = np.where(ca > 0, a, b)
        # 0 to 7: how frequent the id is by order 0, by powers of two of its share
        level = np.clip(10 - np.frexp(int(self.cum[-1]) // self.freq[guess])[1], 0, 7)
        return guess, ((ca.astype(np.int64) * 8 + cb) * 2 + (a == b)) * 8 + level, slot

    def learn(self, ids, one, slot, context, came_true):
        for guess, sure, at in ((self.guess2, self.sure2, slot), (self.guess1, self.sure1, one)):
            right = guess[at] == ids
            c = sure[at]
            # wrong and unsure: the new id takes the place; wrong and sure: less sure; right: more so
            new = np.where(right, np.minimum(c + 1, 7), np.maximum(c >> 1, 0)).astype(np.int8)
            replace = ~right & (c <= 1)
            guess[at[replace]] = ids[replace]
            new[replace] = 1
            sure[at] = new
        self.hit += np.bincount(context[came_true], minlength=1024)
        self.all += np.bincount(context, minlength=1024)
        np.add.at(self.freq, ids, _STEP)
        self.refresh()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


class _Out:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.words, self.n = np.zeros((lanes, steps + 8), np.uint32), np.zeros(lanes, np.int64)

    def add(self, lanes, amount):
        """lanes: indices, or a slice."""
        old = self.low[lanes].copy()
        new = old + amount
        self.low[lanes] = new
        over = np.flatnonzero(new < old)
        if len(over):
            at = over if isinstance(lanes, slice) else lanes[over]
            back = self.n[at] - 1
            while len(at):
                self.words[at, back] += np.uint32(1)
                more = self.words[at, back] == 0
                at, back = at[more], back[more] - 1

    def shift(self, m: int):
        at = np.flatnonzero(self.range[:m] < _BOTTOM)
        if len(at):
            if int(self.n[at].max()) + 2 >= self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            low = self.low[at]
            self.words[at, self.n[at]] = (low >> _S32).astype(np.uint32)
            self.n[at] += 1
            self.low[at] = low << _S32
            self.range[at] <<= _S32

    def finish(self):
        """A word whose value, followed by zeros, lies in the last interval."""
        full = U((1 << 32) - 1)
        up = (~self.low + U(1)) & full  # to the next multiple of 2**32
        self.add(slice(None), up)
        if int(self.n.max()) + 1 >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[np.arange(len(self.n)), self.n] = (self.low >> _S32).astype(np.uint32)
        self.n += 1


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """A self-contained block: head, CRC-32, lengths of the lanes, words of the lanes."""
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, 0, vocab, 0, 0, 0)
    lanes, steps = _shape(n)
    ids = ids.astype(np.int64)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, out = _Model(vocab), _Out(lanes, steps)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        m = -(-(n - t) // steps)  # lanes that still have an id
        x = grid[t, :m]
        one, two = one[:m], two[:m]
        guess, context, slot = model.predict(one, two)
        true = guess == x
        bound = (out.range[:m] >> _S16) * model.chance[context]
        out.add(slice(0, m), np.where(true, U(0), bound))
        out.range[:m] = np.where(true, bound, out.range[:m] - bound)
        out.shift(m)
        rest = np.flatnonzero(~true)
        if len(rest):
            s = x[rest]
            r = out.range[rest] // U(int(model.cum[-1]))
            out.add(rest, r * model.cum[s].astype(np.uint64))
            out.range[rest] = r * model.freq[s].astype(np.uint64)
            out.shift(m)
        model.learn(x, one, slot, context, true)
        one, two = x, one
    out.finish()
    lengths = out.n.astype("<u4")
    body = lengths.tobytes() + out.words[np.arange(out.words.shape[1])[None, :] < out.n[:, None]].astype("<u4").tobytes()
    return HEAD.pack(MAGIC, n, vocab, lanes, len(body), zlib.crc32(body)) + body


def block_size(head: bytes) -> int:
    """Bytes that follow the head."""
    magic, _, _, _, size, _ = HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError("no block of token ids begins here")
    return size


def decode_block(head: bytes, body: bytes) -> np.ndarray:
    magic, n, vocab, lanes, size, crc = HEAD.unpack(head)
    if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("a block of token ids is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    length = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    flat = np.concatenate([np.frombuffer(body, "<u4", offset=4 * lanes).astype(np.uint64), np.zeros(1, np.uint64)])
    start = np.cumsum(length) - length
    stop = start + length
    nothing = len(flat) - 1
    take = lambda at, lane: flat[np.where(at < stop[lane], at, nothing)]
    every = np.arange(lanes)
    pos = start + 2
    code = (take(start, every) << _S32) | take(start + 1, every)
    width = np.full(lanes, (1 << 64) - 1, np.uint64)
    model, grid = _Model(vocab), np.zeros((steps, lanes), np.int64)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def shift(m):
        at = np.flatnonzero(width[:m] < _BOTTOM)
        if len(at):
            width[at] <<= _S32
            code[at] = (code[at] << _S32) | take(pos[at], at)
            pos[at] += 1

    for t in range(steps):
        m = -(-(n - t) // steps)
        one, two = one[:m], two[:m]
        guess, context, slot = model.predict(one, two)
        bound = (width[:m] >> _S16) * model.chance[context]
        true = code[:m] < bound
        code[:m] -= np.where(true, U(0), bound)
        width[:m] = np.where(true, bound, width[:m] - bound)
        shift(m)
        x = guess.astype(np.int64)
        rest = np.flatnonzero(~true)
        if len(rest):
            total = int(model.cum[-1])
            r = width[rest] // U(total)
            v = np.minimum(code[rest] // r, U(total - 1)).astype(np.int64)
            s = np.searchsorted(model.cum, v, "right") - 1
            code[rest] -= r * model.cum[s].astype(np.uint64)
            width[rest] = r * model.freq[s].astype(np.uint64)
            x[rest] = s
            shift(m)
        grid[t, :m] = x
        model.learn(x, one, slot, context, true)
        one, two = x, one
    return np.ascontiguousarray(grid.T).ravel()[:n].astype(np.uint32)
