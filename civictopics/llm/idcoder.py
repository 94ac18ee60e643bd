"""Adaptive range coder for token ids, over many independent blocks at once.

A block starts with empty models and codes each id with what came before it in the block:

* orders 1 and 2 each predict one id, the last that followed the same one or two ids, with a count
  of how often that came true in a row; order 0 knows how often predictions hit at all.  A logistic
  mixture of the three, with weights that adapt, gives the chance that the prediction of the
  highest order is right, and one binary decision codes whether it is;
* after a miss, a second decision codes whether the prediction of order 1 is right, if it differs;
* otherwise the id is coded by its hex digits, from adaptive distributions of order 0, each digit
  in the context of those before it.

Decisions drive a carry-less range coder with 64-bit state and 32-bit output words.  All
arithmetic is on integers, so encoder and decoder agree on every machine.  The blocks of a group
are coded in step: each numpy operation advances all of them by one decision.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 4096
GROUP = 2048

_SLOT_BITS = 11
_DIGIT_SLOTS = 256
_TOTAL = np.uint64(32768 + 16 * 8)
_WORD, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)
_SIXTEEN, _ONE = np.uint64(16), np.uint64(1)
_PLACES = np.arange(16, dtype=np.int32)
# Where the cumulative distribution over digits goes after each digit: 0 up to it, full beyond.
_GOAL = np.where(_PLACES[None, :] > _PLACES[:, None], 32767, 0).astype(np.int16)

# Logistic scale: chances of 12 bits, their logits in 256ths.
_chances = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.round(256 * np.log(_chances / (1 - _chances))).astype(np.int32)
_SQUASH = np.clip(np.round(65536 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 64, 65472).astype(np.int32)


class _Models:
    """The models of a group of blocks; the first ``n`` blocks are still being coded."""

    def __init__(self, blocks: int, digits: int) -> None:
        self.digits = digits
        self.lane = np.arange(blocks, dtype=np.int64)
        self.guess = [np.zeros(blocks << _SLOT_BITS, dtype=np.uint32) for _ in range(2)]
        self.sure = [np.zeros(blocks << _SLOT_BITS, dtype=np.uint8) for _ in range(2)]
        # Chance of a hit by the count of order 2, by that of order 1, and by whether the last one hit.
        self.hit = [np.full(blocks * n, 2048 << 4, dtype=np.int32) for n in (16, 16, 4)]
        self.second = np.full(blocks * 16, 2048 << 4, dtype=np.int32)
        self.weights = np.full((3, blocks), 1 << 14, dtype=np.int32)
        self.cdf = np.tile((_PLACES * 2048).astype(np.int16), (blocks * digits * _DIGIT_SLOTS, 1))
        self.before, self.last = np.zeros(blocks, dtype=np.uint32), np.zeros(blocks, dtype=np.uint32)
        self.recent = np.zeros(blocks, dtype=np.int64)

    def look(self, n: int) -> None:
        """Predictions for the next id of each block."""
        lane, last, before = self.lane[:n], self.last[:n], self.before[:n]
        shift = np.uint32(32 - _SLOT_BITS)
        one = ((last + np.uint32(1)) * np.uint32(0x9E3779B1)) >> shift
        two = ((last * np.uint32(0x85EBCA6B) ^ (before + np.uint32(1)) * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> shift
        base = lane << _SLOT_BITS
        self.slots = (base + one, base + two)
        self.ids = [self.guess[k][self.slots[k]] for k in (0, 1)]
        self.counts = [self.sure[k][self.slots[k]].astype(np.int64) for k in (0, 1)]
        known = self.counts[1] > 0
        self.best = np.where(known, self.ids[1], self.ids[0])
        self.places = ((lane << 4) + self.counts[1], (lane << 4) + self.counts[0], (lane << 2) + self.recent[:n])
        self.logits = [_STRETCH[self.hit[k][self.places[k]] >> 4] for k in range(3)]
        mixed = sum(self.weights[k, :n] * self.logits[k] for k in range(3)) >> 15
        self.chance = _SQUASH[np.clip(mixed + 2048, 0, 4095)]
        self.second_place = (lane << 4) + self.counts[0]

    def learn(self, n: int, ids: np.ndarray, hit: np.ndarray) -> None:
        """What the ids were, and whether the best prediction was right."""
        error = np.where(hit, 65536, 0).astype(np.int32) - self.chance
        for k in range(3):
            self.weights[k, :n] += (self.logits[k] * (error >> 4)) >> 9
            chance = self.hit[k][self.places[k]]
            self.hit[k][self.places[k]] = chance + ((np.where(hit, 65535, 0) - chance) >> 4)
        np.clip(self.weights[:, :n], -(1 << 17), 1 << 17, out=self.weights[:, :n])
        for k in (0, 1):
            right = (self.ids[k] == ids) & (self.counts[k] > 0)
            self.sure[k][self.slots[k]] = np.where(right, np.minimum(self.counts[k] + 1, 15), 1)
            self.guess[k][self.slots[k]] = ids
        self.recent[:n] = (self.recent[:n] * 2 + hit) & 3
        self.before[:n], self.last[:n] = self.last[:n].copy(), ids

    def digit_rows(self, lanes: np.ndarray, digit: int, above: np.ndarray) -> np.ndarray:
        """Where the distribution of a digit lies, given the digits above it."""
        context = (above * 0x9E3779B1 >> 7) % _DIGIT_SLOTS if digit > 1 else above
        return (lanes * self.digits + digit) * _DIGIT_SLOTS + context

    def cumulative(self, rows: np.ndarray) -> np.ndarray:
        return self.cdf[rows]

    def learn_digit(self, rows: np.ndarray, held: np.ndarray, digit: np.ndarray) -> None:
        self.cdf[rows] = held + ((_GOAL[digit] - held) >> 4)


class _Encoder:
    def __init__(self, blocks: int, words: int) -> None:
        self.low, self.range = np.zeros(blocks, dtype=np.uint64), np.full(blocks, ~np.uint64(0), dtype=np.uint64)
        self.words, self.used = np.zeros((blocks, words), dtype="<u4"), np.zeros(blocks, dtype=np.int64)

    def _settle(self, lanes, low, span) -> None:
        small = span <= _MASK
        if small.any():
            at = np.flatnonzero(small)
            l, s = low[at], span[at]
            crossing = ((l ^ (l + s - _ONE)) >> _WORD) != 0
            s = np.where(crossing, (_MASK + _ONE) - (l & _MASK), s)
            to = at if isinstance(lanes, slice) else lanes[at]
            self.words[to, self.used[to]] = l >> _WORD
            self.used[to] += 1
            low[at], span[at] = l << _WORD, s << _WORD
        self.low[lanes], self.range[lanes] = low, span

    def flag(self, lanes, chance: np.ndarray, bit: np.ndarray) -> None:
        low, span = self.low[lanes], self.range[lanes]
        bound = (span >> _SIXTEEN) * chance.astype(np.uint64)
        self._settle(lanes, np.where(bit, low, low + bound), np.where(bit, bound, span - bound))

    def digit(self, lanes, start: np.ndarray, end: np.ndarray) -> None:
        step = self.range[lanes] // _TOTAL
        self._settle(lanes, self.low[lanes] + step * start, step * (end - start))

    def finish(self) -> list[bytes]:
        for _ in range(2):
            every = np.arange(len(self.low))
            self.words[every, self.used] = self.low >> _WORD
            self.used += 1
            self.low <<= _WORD
        return [self.words[i, :n].tobytes() for i, n in enumerate(self.used)]


class _Decoder:
    def __init__(self, coded: Sequence[bytes]) -> None:
        blocks, longest = len(coded), max(len(c) for c in coded) // 4
        # Zeros beyond the end stand for words that no decision depends on.
        self.words = np.zeros((blocks, longest + 4), dtype=np.uint64)
        for i, c in enumerate(coded):
            self.words[i, : len(c) // 4] = np.frombuffer(c, "<u4")
        self.low, self.range = np.zeros(blocks, dtype=np.uint64), np.full(blocks, ~np.uint64(0), dtype=np.uint64)
        self.ahead, self.used = self.words[:, 0] << _WORD | self.words[:, 1], np.full(blocks, 2)

    def _settle(self, lanes, low, span, ahead) -> None:
        small = span <= _MASK
        if small.any():
            at = np.flatnonzero(small)
            l, s = low[at], span[at]
            crossing = ((l ^ (l + s - _ONE)) >> _WORD) != 0
            s = np.where(crossing, (_MASK + _ONE) - (l & _MASK), s)
            to = at if isinstance(lanes, slice) else lanes[at]
            ahead[at] = ahead[at] << _WORD | self.words[to, np.minimum(self.used[to], self.words.shape[1] - 1)]
            self.used[to] += 1
            low[at], span[at] = l << _WORD, s << _WORD
        self.low[lanes], self.range[lanes], self.ahead[lanes] = low, span, ahead

    def flag(self, lanes, chance: np.ndarray) -> np.ndarray:
        low, span, ahead = self.low[lanes], self.range[lanes], self.ahead[lanes]
        bound = (span >> _SIXTEEN) * chance.astype(np.uint64)
        bit = ahead < bound
        self._settle(lanes, np.where(bit, low, low + bound), np.where(bit, bound, span - bound),
                     np.where(bit, ahead, ahead - bound))
        return bit

    def digit(self, lanes, cumulative: np.ndarray) -> np.ndarray:
        low, ahead = self.low[lanes], self.ahead[lanes]
        step = self.range[lanes] // _TOTAL
        aim = np.minimum(ahead // step, _TOTAL - _ONE).astype(np.int32)
        digit = (cumulative <= aim[:, None]).sum(axis=1) - 1
        start, end = _bounds(cumulative, digit)
        self._settle(lanes, low + step * start, step * (end - start), ahead - step * start)
        return digit


def _bounds(cumulative: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, at = cumulative.ravel(), np.arange(len(digit)) * 16 + digit
    start = flat[at].astype(np.uint64)
    end = np.where(digit == 15, _TOTAL, flat[np.minimum(at + 1, len(flat) - 1)].astype(np.uint64))
    return start, end


def _code(lengths: Sequence[int], digits: int, coder, ids: np.ndarray | None) -> np.ndarray:
    """Run the models over blocks of non-increasing ``lengths``; without ``ids``, decode them."""
    blocks, encode = len(lengths), ids is not None
    models, out = _Models(blocks, digits), ids if encode else np.zeros((blocks, max(lengths)), dtype=np.uint32)
    ends = np.searchsorted(-np.asarray(lengths), -np.arange(max(lengths)), side="left")
    for step, n in enumerate(ends):
        every = slice(0, n)
        models.look(n)
        if encode:
            now = out[:n, step]
            hit = now == models.best
            coder.flag(every, models.chance, hit)
        else:
            hit = coder.flag(every, models.chance)
            now = np.where(hit, models.best, 0).astype(np.uint32)
        rest = np.flatnonzero(~hit)
        # A second prediction is asked for where order 1 knows another id than order 2.
        asked = rest[(models.counts[0][rest] > 0) & (models.ids[0][rest] != models.best[rest])]
        if len(asked):
            place = models.second_place[asked]
            held, guess = models.second[place], models.ids[0][asked]
            if encode:
                right = now[asked] == guess
                coder.flag(asked, held, right)
            else:
                right = coder.flag(asked, held)
                now[asked] = np.where(right, guess, 0)
            models.second[place] = np.clip(held + ((np.where(right, 65536, 0) - held) >> 5), 64, 65472)
            done = np.zeros(n, dtype=bool)
            done[asked[right]] = True
            rest = rest[~done[rest]]
        if len(rest):
            above = np.zeros(len(rest), dtype=np.int64)
            given = now[rest].astype(np.int64)
            for digit in range(digits):
                rows = models.digit_rows(rest, digit, above)
                held = models.cumulative(rows)
                cumulative = held + _PLACES * 8
                if encode:
                    value = (given >> 4 * (digits - 1 - digit)) & 15
                    coder.digit(rest, *_bounds(cumulative, value))
                else:
                    value = coder.digit(rest, cumulative)
                models.learn_digit(rows, held, value)
                above = above * 16 + value
            if not encode:
                now[rest] = above
        if not encode:
            out[:n, step] = now
        models.learn(n, now, hit)
    return out


def group_size(blocks: int) -> int:
    """Groups of equal size, since a step costs nearly as much for few blocks as for many."""
    return -(-blocks // max(1, -(-blocks // GROUP)))


def encode(blocks: Sequence[np.ndarray], digits: int) -> list[bytes]:
    """Coded form of each block of ids below ``16 ** digits``, none of them empty."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    size = group_size(len(order))
    for at in range(0, len(order), size or 1):
        group = order[at : at + size]
        lengths = [len(blocks[i]) for i in group]
        ids = np.zeros((len(group), lengths[0]), dtype=np.uint32)
        for row, i in enumerate(group):
            ids[row, : lengths[row]] = blocks[i]
        # Two decisions and the digits of an id take less than 12 bytes.
        coder = _Encoder(len(group), 3 * lengths[0] + 8)
        _code(lengths, digits, coder, ids)
        for i, coded in zip(group, coder.finish()):
            out[i] = coded
    return out


def decode(coded: Sequence[bytes], lengths: Sequence[int], digits: int) -> list[np.ndarray]:
    """The ids of each coded block."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(coded)
    order = sorted(range(len(coded)), key=lambda i: -lengths[i])
    size = group_size(len(order))
    for at in range(0, len(order), size or 1):
        group = order[at : at + size]
        ids = _code([lengths[i] for i in group], digits, _Decoder([coded[i] for i in group]), None)
        for row, i in enumerate(group):
            out[i] = ids[row, : lengths[i]]
    return out


def checksum(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
