"""Adaptive context-mixing range coder for token ids.

``encode`` and ``decode`` take many blocks at once and step through them side by
side, one lane per block, so that numpy works on a lane's neighbours instead of
Python on one id. Every block starts from nothing and stands alone.

A block's ids are written as ranks among its distinct ids, which it carries.
Three predictions are mixed for the next rank:

* order 2: the successor last trusted after the two ranks before (hashed);
* order 1: the successor last trusted after the rank before;
* order 0: the ranks' frequencies so far (renewed at fixed steps).

A trusted successor has a confidence from 1 to 7 that grows with each hit and
halves at a miss; below 3 a miss replaces it. How much of the probability
orders 2 and 1 get, is learned per pair of confidences and whether both name
the same successor; order 0 gets the rest. The mixture's interval drives one
step of a range coder with 48 bits and 16-bit words. All of it is integer
arithmetic, so any machine decodes what another encoded.
"""

from __future__ import annotations

import numpy as np

TOTAL = 1 << 24             # probabilities are in 24 bits
MOST = TOTAL - (1 << 19)    # orders 1 and 2 leave order 0 this much at least
RATE = 4                    # a share moves by 1/16 of what it is off
GAIN = 2                    # what an occurrence adds to a frequency; every rank begins with 1
SCALE = 18                  # bits of a scaled frequency: more than those of all ranks of a block sum up to
SLOTS = 10                  # first bits of a scaled frequency by which ranks are found
TOP, LOW = 48, 32           # bits of the coder's range, and below which a word leaves
MAX_IDS = 1 << 16           # ids of a block

_CONFIDENCE = np.arange(8)
_TRUST_2, _TRUST_1, _SAME = np.meshgrid(_CONFIDENCE, _CONFIDENCE, np.arange(2), indexing="ij")
#: First shares by context; nought where there is no successor, or none of its own.
SHARES = ((np.where(_TRUST_2 > 0, TOTAL // 8, 0) << 32)
          | np.where((_TRUST_1 > 0) & (_SAME == 0), TOTAL // 8, 0)).reshape(128)
#: Confidence after a miss or a hit (from 8 on); nought: the successor is replaced.
TRUST = np.array([*(c >> 1 if c >= 3 else 0 for c in range(8)), *(min(c + 1, 7) for c in range(8))], dtype=np.int16)


def renewals(n: int) -> list[int]:
    """Steps before which frequencies are renewed: doubling, then every 1024; and the end."""
    return [s for s in (0, 16, 32, 64, 128, 256, 512) if s < n] + list(range(1024, n, 1024)) + [n]


class Mixer:
    """The three predictions of every lane, and what they learn."""

    def __init__(self, sizes: np.ndarray, lengths: np.ndarray):
        lanes, most = len(sizes), int(sizes.max())
        # By the block's own length: what a lane does mustn't depend on its neighbours.
        pairs = np.array([1 << max(4, (n - 1).bit_length() - 1) for n in lengths.tolist()])
        self.pair_mask = pairs - 1
        small = np.int16 if (most + 1) << 3 < 1 << 15 else np.int32
        # The tables of all lanes lie end to end: what is read and written stays close together.
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes
        self.base = np.arange(lanes) << SCALE
        self.from_2, self.from_share = np.cumsum(pairs) - pairs, np.arange(lanes) * 128
        entries = int(self.ends[-1])
        self.next_1 = np.zeros(entries, dtype=small)
        self.next_2 = np.zeros(int(pairs.sum()), dtype=small)
        self.share = np.tile(SHARES, lanes)
        self.count = np.ones(entries, dtype=np.int64)
        self.owner = np.repeat(np.arange(lanes), sizes)
        self.below = np.zeros(entries + 1, dtype=np.int32 if lanes << SCALE < 1 << 31 else np.int64)
        self.sizes = sizes
        self.last = np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.int64)

    def keep(self, lanes: int) -> None:
        """Only the first ``lanes`` go on."""
        for name in ("first", "ends", "base", "from_2", "pair_mask", "from_share", "sizes", "last", "before"):
            setattr(self, name, getattr(self, name)[:lanes])

    def renew(self, step: int, done: np.ndarray) -> None:
        """Scaled frequencies below each rank, as they are before ``step``; the
        lanes' tables in a row ascend, so they are searched as one. ``done``:
        the ranks since the last time."""
        used, k = int(self.ends[-1]), len(self.ends)
        if len(done):
            self.count[:used] += GAIN * np.bincount((self.first + done[:, :k]).reshape(-1), minlength=used)
        below = np.cumsum(self.count[:used]) - self.count[:used]
        owner = self.owner[:used]
        below -= below[self.first].take(owner)
        self.below[:used] = (below << SCALE) // (self.sizes + GAIN * step).take(owner) + self.base.take(owner)
        self.below[used] = k << SCALE
        self.searched = self.below[:used + 1]

    def predict(self) -> None:
        self.at_1 = self.first + self.last
        self.at_2 = self.from_2 + ((self.last * 40503 + self.before * 30103) & self.pair_mask)
        self.one, self.two = self.next_1.take(self.at_1), self.next_2.take(self.at_2)
        self.word_1, self.word_2 = self.one >> 3, self.two >> 3     # rank + 1; nought: none
        self.sure_1, self.sure_2 = self.one & 7, self.two & 7
        self.at_share = self.from_share + ((self.sure_2 << 4) + (self.sure_1 << 1) + (self.word_1 == self.word_2))
        share = self.share.take(self.at_share)
        self.p2, self.p1 = share >> 32, share & 0xFFFFFFFF
        self.named = self.p2 + self.p1
        self.rest = TOTAL - self.named

    def index(self) -> None:
        """For each lane and first bits of a scaled frequency, the last rank that
        begins below; then how many steps of halving find the others."""
        n = np.bincount(self.searched[:-1] >> (SCALE - SLOTS), minlength=len(self.ends) << SLOTS)
        self.slot = (np.cumsum(n) - n - 1).astype(np.int32)
        self.halves = [1 << b for b in reversed(range(int(n.max()).bit_length()))]

    def rank(self, t: np.ndarray) -> np.ndarray:
        """The ranks whose intervals hold ``t``."""
        left = np.maximum(t - self.named, 0)
        v = _quotient(((left + 1) << SCALE) - 1, self.rest) + self.base
        at = self.slot.take(v >> (SCALE - SLOTS)).astype(np.int64)
        for half in self.halves:
            at += (self.searched.take(at + half, mode="clip") <= v) * np.int64(half)
        rank = np.where(t < self.p2, self.word_2, self.word_1) - np.int64(1)
        return np.where(t < self.named, rank, at - self.first)

    def frequencies(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled frequencies below the ranks and up to them."""
        at = self.first + rank
        return self.searched.take(at) - self.base, self.searched.take(at + 1) - self.base

    def interval(self, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the ranks' intervals, from their scaled
        frequencies; then learns the ranks."""
        word = rank + 1
        hit_2, hit_1 = word == self.word_2, word == self.word_1
        own_1 = hit_1 > hit_2
        start = low * self.rest >> SCALE
        size = (high * self.rest >> SCALE) - start
        start += self.named
        named = np.flatnonzero(hit_2 | hit_1)
        by_2 = hit_2.take(named)
        p2, p1 = self.p2.take(named), self.p1.take(named)
        start[named] = np.where(by_2, 0, p2)
        size[named] = np.where(by_2, p2, p1)
        p2 = self.p2 + ((hit_2 * (MOST - 15) - self.p2 + 15) >> RATE)     # falls no lower than 15
        p1 = self.p1 + ((own_1 * (MOST - 15) - self.p1 + 15) >> RATE)
        self.share[self.at_share] = (p2 << 32) | p1
        new = (word << 3) | 1
        for hit, old, sure, table, place in ((hit_1, self.one, self.sure_1, self.next_1, self.at_1),
                                             (hit_2, self.two, self.sure_2, self.next_2, self.at_2)):
            trust = TRUST.take(sure + (hit << np.int8(3)))
            table[place] = np.where(trust, old - sure + trust, new)
        self.before, self.last = self.last, rank
        return start, size


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` by doubles, which is faster. Exact: below 2^48 by up to 2^24, a
    quotient below 2^25 is no closer to the next whole number than 2^-24."""
    return (a / b).astype(np.int64)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids ascending and the rank of each id among them; by a table where ids are small, without sorting."""
    most = int(ids.max()) + 1
    if most > MAX_IDS:
        return np.unique(ids, return_inverse=True)
    seen, table = np.zeros(most, dtype=bool), np.zeros(most, dtype=np.int32)
    seen[ids] = True
    known = np.flatnonzero(seen)
    table[known] = np.arange(len(known), dtype=np.int32)
    return known.astype(ids.dtype), table.take(ids)


def encode(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct ids ascending, 16-bit words) of each block of unsigned ids.
    Blocks hold 1 to ``MAX_IDS`` ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    if not order:
        return []
    longest = len(blocks[order[0]])
    if longest > MAX_IDS or not all(len(b) for b in blocks):
        raise ValueError(f"a block holds 1 to {MAX_IDS} ids")
    lengths = np.array([len(blocks[i]) for i in order])
    known, ranks = [], np.zeros((longest, len(order)), dtype=np.int32)
    for lane, i in enumerate(order):
        ids, ranks[:len(blocks[i]), lane] = _distinct(blocks[i])
        known.append(ids)
    mixer, renew = Mixer(np.array([len(k) for k in known]), lengths), renewals(longest)
    nth, since = 0, 0
    low, span = np.zeros(len(order), dtype=np.int64), np.full(len(order), 1 << TOP, dtype=np.int64)
    words, used = np.zeros((len(order), longest + 8), dtype=np.uint32), np.zeros(len(order), dtype=np.int64)
    k = len(order)
    ends = np.searchsorted(-lengths, -np.arange(longest), side="left")      # lanes longer than a step
    for step in range(longest):
        if ends[step] < k:
            k = int(ends[step])
            mixer.keep(k)
        if step == renew[nth]:
            mixer.renew(step, ranks[since:step])
            nth, since = nth + 1, step
            some = ranks[step:renew[nth], :k].astype(np.int64)
            below, above = mixer.frequencies(some)
        mixer.predict()
        start, size = mixer.interval(some[step - since, :k], below[step - since, :k], above[step - since, :k])
        part = span[:k] >> 24
        low[:k] += start * part
        span[:k] = size * part
        go = np.flatnonzero(span[:k] <= 1 << LOW)
        if len(go) and int(used[go].max()) + 8 >= words.shape[1]:
            words = np.pad(words, ((0, 0), (0, words.shape[1])))
        while len(go):
            words[go, used[go]] = low[go] >> LOW     # a carry makes it longer than 16 bits until the end
            used[go] += 1
            low[go] = (low[go] & ((1 << LOW) - 1)) << 16
            span[go] <<= 16
            go = go[span[go] <= 1 << LOW]
    for shift in (32, 16, 0):
        words[np.arange(len(order)), used] = (low >> shift) & (0xFFFF if shift < 32 else 0x1FFFF)
        used += 1
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    out: list = [None] * len(order)
    for lane, i in enumerate(order):
        out[i] = known[lane], words[lane, :used[lane]].astype("<u2")
    return out


def decode(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The ids of blocks given as (number of ids, distinct ids, words)."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    if not order:
        return []
    lengths = np.array([blocks[i][0] for i in order])
    longest, k = int(lengths[0]), len(order)
    if longest > MAX_IDS or int(lengths[-1]) < 1 or not all(len(b[1]) for b in blocks):
        raise ValueError("damaged block")
    code = np.zeros((k, max(len(b[2]) for b in blocks) + 8), dtype=np.int64)
    for lane, i in enumerate(order):
        code[lane, :len(blocks[i][2])] = blocks[i][2]
    mixer, renew = Mixer(np.array([len(blocks[i][1]) for i in order]), lengths), renewals(longest)
    nth, since = 0, 0
    above = (code[:, 0] << 32) | (code[:, 1] << 16) | code[:, 2]     # of the code, over the range's start
    span = np.full(k, 1 << TOP, dtype=np.int64)
    flat, at = code.reshape(-1), np.arange(k) * code.shape[1] + 3
    last = np.arange(1, k + 1) * code.shape[1] - 1
    ranks = np.zeros((longest, k), dtype=np.int32)
    ends = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for step in range(longest):
        if ends[step] < k:
            k = int(ends[step])
            mixer.keep(k)
            above, span, at, last = above[:k], span[:k], at[:k], last[:k]
        if step == renew[nth]:
            mixer.renew(step, ranks[since:step])
            mixer.index()
            nth, since = nth + 1, step
        mixer.predict()
        part = span >> 24
        rank = mixer.rank(np.minimum(_quotient(above, part), TOTAL - 1))
        start, size = mixer.interval(rank, *mixer.frequencies(rank))
        ranks[step, :k] = rank
        above = above - start * part
        span = size * part
        while (go := span <= 1 << LOW).any():
            above = np.where(go, (above << 16) | flat.take(np.minimum(at, last)), above)
            at += go
            span <<= go * np.int64(16)
    out: list = [None] * len(order)
    for lane, i in enumerate(order):
        out[i] = blocks[i][1][ranks[:lengths[lane], lane]]
    return out
