"""An adaptive context-mixing range coder for token ids.

Many blocks are coded in step, one id of each at a time, so every step is
NumPy over the blocks.  A block's state starts anew; nothing is shared.

The distribution of the next id mixes three predictions:

* order 0: ids in buckets of powers of two; a bucket's ids share one adaptive
  frequency, so every id has some;
* order 1: one id, learnt for the last id, with a confidence;
* order 2: one id, learnt for the last two ids, with a confidence.

The weights of the two predicted ids beside order 0 are learnt, by their
confidences, from how often each was right.  A predicted id stands in the
range with the weight of its highest order alone, so all ids have one place.
"""

from __future__ import annotations

import numpy as np

N_IDS = 1 << 16
#: ids of a block; bits of the context tables; a confidence is 0 to 7
BLOCK, BITS1, BITS2 = 4096, 10, 12
#: order-0 frequency that an id adds, spread over its bucket; the sum at which all are halved
STEP, MASS = 2048, 1 << 20
#: a weight moves by RATE to the bound for a wrong or a right prediction
RATE, PULL = 1 / 32, np.array([0.002, 0.98])
#: change of a confidence after a wrong (0-7) and a right (8-15) prediction
CHANGE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)

#: buckets start at 0, 16, 32, 64, ... and are cut to 4096 ids from there on
STARTS = np.array([0, *[16 << k for k in range(8)], *range(4096, N_IDS, 4096)], np.int64)
SIZES = np.diff(np.concatenate((STARTS, [N_IDS])))
BITS = np.log2(SIZES).astype(np.int64)
BUCKET = np.repeat(np.arange(len(STARTS)), SIZES)
#: what an id of a bucket adds to the frequencies below each bucket
GROWTH = ((np.arange(len(STARTS) + 1)[None, :] > np.arange(len(STARTS))[:, None])
          * (np.maximum(STEP // SIZES, 1) * SIZES)[:, None]).astype(np.int32)
TOP, BOTTOM, WORD, HIGH = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16), np.uint64(48)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Model:
    """The adaptive state of several blocks; all tables are flat, block after block."""

    def __init__(self, lanes: int):
        rows = np.arange(lanes)
        self.at1, self.at2 = rows << BITS1, rows << BITS2
        #: id << 3 | confidence
        self.order1, self.order2 = np.zeros(lanes << BITS1, np.int32), np.zeros(lanes << BITS2, np.int32)
        self.mix = rows << 6
        self.weight1, self.weight2 = np.full(lanes << 6, 0.1), np.full(lanes << 6, 0.1)
        self.below = np.tile(np.concatenate(([0], np.cumsum(SIZES))).astype(np.int32), (lanes, 1))
        self.flat = self.below.reshape(-1)
        self.at0 = rows * (len(STARTS) + 1)
        self.total_at = self.at0 + len(STARTS)
        self.last = np.zeros(lanes, np.int64)
        self.mixed = np.zeros(lanes, np.int64)

    def predict(self) -> None:
        """Look the contexts up; sets the predicted ids p1 and p2 and the range: order 0 has ``total0``,
        then ``f1`` and ``f2`` for the predicted ids."""
        self.s1 = self.at1 + ((self.last * 40503 >> 5) & ((1 << BITS1) - 1))
        self.s2 = self.at2 + ((self.mixed + self.last * 30011 >> 4) & ((1 << BITS2) - 1))
        self.e1, self.e2 = self.order1[self.s1], self.order2[self.s2]
        self.p1, self.p2 = self.e1 >> np.int32(3), self.e2 >> np.int32(3)
        self.c1, self.c2 = self.e1 & np.int32(7), self.e2 & np.int32(7)
        self.m = self.mix + (self.c2 << np.int32(3)) + self.c1
        self.w1, self.w2 = self.weight1[self.m], self.weight2[self.m]
        self.total0 = self.flat[self.total_at].astype(np.int64)
        rest = 1.0 - self.w1
        self.f1 = (self.total0 * self.w1 / rest).astype(np.int64) + 1
        self.f2 = (self.total0 * self.w2 / (rest * (1.0 - self.w2))).astype(np.int64) + 1
        self.total = self.total0 + self.f1 + self.f2

    def order0(self, ids: np.ndarray, b: np.ndarray, at0: np.ndarray):
        """(frequency below an id, its own) by order 0."""
        at = at0 + b
        low = self.flat[at].astype(np.int64)
        f = (self.flat[at + 1] - low) >> BITS[b]
        return low + f * (ids - STARTS[b]), f

    def update(self, ids: np.ndarray, b: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """A right prediction gains confidence; a wrong one loses it, and its place when little is left."""
        new = (ids.astype(np.int32) << np.int32(3)) | np.int32(1)
        for table, slot, old, sure, hit in ((self.order1, self.s1, self.e1, self.c1, hit1), (self.order2, self.s2, self.e2, self.c2, hit2)):
            k = sure + (hit << 3)
            nxt = old + CHANGE[k]
            np.copyto(nxt, new, where=k < 2)
            table[slot] = nxt
        self.weight1[self.m] = self.w1 + (PULL[hit1.view(np.int8)] - self.w1) * RATE
        self.weight2[self.m] = self.w2 + (PULL[hit2.view(np.int8)] - self.w2) * RATE
        self.below += GROWTH[b]
        big = np.flatnonzero(self.total0 > MASS)
        if len(big):
            f = np.diff(self.below[big].astype(np.int64), axis=1) >> BITS
            self.below[big, 1:] = np.cumsum(((f + 1) >> 1) * SIZES, axis=1)
        self.mixed, self.last = self.last * 40503, ids


def _narrow(low, rng, total, start, f, unit) -> None:
    low += unit * start.astype(np.uint64)
    np.multiply(unit, f.astype(np.uint64), out=rng)


def _settled(low, rng, on=None):
    """Places whose leading word is settled, after cutting short ranges that straddle it."""
    lo, r = (low, rng) if on is None else (low[on], rng[on])
    go = (lo ^ (lo + r)) < TOP
    short = np.flatnonzero(~go & (r < BOTTOM))
    if len(short):
        at = short if on is None else on[short]
        rng[at] = (~low[at] + np.uint64(1)) & (BOTTOM - np.uint64(1))
        go[short] = True
    return np.flatnonzero(go) if on is None else on[go]


def _by_length(n: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Blocks by falling length, and how many are still going at each step (and 0 behind the last)."""
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(int(n.max(initial=0)) + 1), "left").tolist()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids; an empty block has none."""
    n = np.array([len(b) for b in blocks], np.int64)
    out: list[bytes] = [b""] * len(blocks)
    if not len(blocks) or not n.max():
        return out
    order, going = _by_length(n)
    width = int(n.max())
    ids = np.zeros((width, len(blocks)), np.int64)
    for lane, k in enumerate(order.tolist()):
        ids[:n[k], lane] = blocks[k]
    model = Model(len(blocks))
    low, rng = np.zeros(len(blocks), np.uint64), np.full(len(blocks), FULL)
    words = np.zeros((len(blocks), 3 * width + 8), np.uint16)
    used = np.zeros(len(blocks), np.int64)
    ends = np.zeros(len(blocks), np.int64)
    for step in range(width):
        x = ids[step]  # a block that has ended goes on with id 0; its code was closed
        b = BUCKET[x]
        model.predict()
        hit2 = x == model.p2
        hit1 = x == model.p1
        start, f = model.order0(x, b, model.at0)
        start = np.where(hit2, model.total0 + model.f1, np.where(hit1, model.total0, start))
        f = np.where(hit2, model.f2, np.where(hit1, model.f1, f))
        _narrow(low, rng, model.total, start, f, rng // model.total.astype(np.uint64))
        go = _settled(low, rng)
        while len(go):
            words[go, used[go]] = low[go] >> HIGH
            used[go] += 1
            low[go] <<= WORD
            rng[go] <<= WORD
            go = _settled(low, rng, go)
        for lane in range(going[step + 1], going[step]):
            words[lane, used[lane]:used[lane] + 4] = [(int(low[lane]) >> k) & 0xFFFF for k in (48, 32, 16, 0)]
            used[lane] = ends[lane] = used[lane] + 4
        model.update(x, b, hit1, hit2)
    for lane, k in enumerate(order.tolist()):
        out[k] = words[lane, :ends[lane]].astype("<u2").tobytes()
    return out


def decode(codes: list[bytes], n: np.ndarray) -> list[np.ndarray]:
    """The ids of each block; n: how many each has."""
    n = np.asarray(n, np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
    if not len(codes) or not n.max():
        return out
    order, _ = _by_length(n)
    width = int(n.max())
    longest = max(len(c) for c in codes) // 2 + 8
    words = np.zeros((len(codes), longest), np.uint64)
    for lane, k in enumerate(order.tolist()):
        w = np.frombuffer(codes[k], "<u2")
        words[lane, :len(w)] = w
    flat, base = words.reshape(-1), np.arange(len(codes)) * longest
    code = np.zeros(len(codes), np.uint64)
    for j in range(4):
        code = (code << WORD) | words[:, j]
    at, end = base + 4, base + longest - 1
    model = Model(len(codes))
    low, rng = np.zeros(len(codes), np.uint64), np.full(len(codes), FULL)
    ids = np.zeros((width, len(codes)), np.int32)
    for step in range(width):
        model.predict()
        unit = rng // model.total.astype(np.uint64)
        v = np.minimum((code - low) // unit, (model.total - 1).astype(np.uint64)).astype(np.int64)
        by2 = v >= model.total0 + model.f1
        x = np.where(by2, model.p2, model.p1).astype(np.int64)
        start = np.where(by2, model.total0 + model.f1, model.total0)
        f = np.where(by2, model.f2, model.f1)
        miss = np.flatnonzero(v < model.total0)
        if len(miss):
            u = v[miss]
            k = (model.below[miss, 1:] <= u[:, None]).sum(axis=1)
            a = model.at0[miss] + k
            lo = model.flat[a].astype(np.int64)
            own = (model.flat[a + 1] - lo) >> BITS[k]
            nth = (u - lo) // own
            x[miss] = STARTS[k] + nth
            start[miss] = lo + nth * own
            f[miss] = own
        ids[step] = x
        _narrow(low, rng, model.total, start, f, unit)
        go = _settled(low, rng)
        while len(go):
            code[go] = (code[go] << WORD) | flat[np.minimum(at[go], end[go])]
            at[go] += 1
            low[go] <<= WORD
            rng[go] <<= WORD
            go = _settled(low, rng, go)
        hit2 = x == model.p2
        model.update(x, BUCKET[x], x == model.p1, hit2)
    for lane, k in enumerate(order.tolist()):
        out[k] = ids[:n[k], lane]
    return out
