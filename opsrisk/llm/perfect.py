"""Minimal perfect hashing of 64-bit keys, in slices.

A slice's keys are hashed into a bit array of about twice their number; keys alone at their place set its bit, the
others go on to the next level's array with another seed. A key's number is the rank of its bit among all set bits of all
levels, so n keys get the numbers 0 to n - 1 and the function needs about four bits a key, not the keys. Any key that is not of the
set gets some number too, so the keys are kept by number and verified.
"""

from __future__ import annotations

import numpy as np

from .textbytes import mix

_U64 = np.uint64
LOAD = 2  # places of a level for each of its keys
LEVELS = 48  # keys that are still not alone then (two in 10^14) are listed
_SLICE_SALT = _U64(0x8F1BBCDCBFA53E0B)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mix(keys.astype(_U64) ^ _SLICE_SALT) % _U64(slices)).astype(np.int64)


def _place(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(keys + _U64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)) % size).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels (whole 64-bit words) for distinct keys, and the keys in the order of their numbers."""
    left, levels, order = keys.astype(_U64), [], []
    while len(left) and len(levels) < LEVELS:
        size = -(-LOAD * len(left) // 64) * 64
        place = _place(left, len(levels), _U64(size))
        count = np.bincount(place, minlength=size)
        alone = count[place] == 1
        bits = np.zeros(size, np.uint8)
        bits[place[alone]] = 1
        levels.append(np.packbits(bits, bitorder="little").view(_U64))
        order.append(left[alone][np.argsort(place[alone])])
        left = left[~alone]
    order.append(np.sort(left))
    return levels, np.concatenate(order) if order else left


class Function:
    """The functions of several slices as one: numbers of a slice follow those of the slice before."""

    def __init__(self, slices: int, parts: dict[int, tuple[list[np.ndarray], np.ndarray]]):
        """``parts``: for each slice that is held, its levels and its keys by number."""
        self.slices = slices
        depth = max((len(levels) for levels, _ in parts.values()), default=0)
        self.first = np.zeros(slices + 1, np.int64)  # number of a slice's first key
        for s, (_, keys) in parts.items():
            self.first[s + 1] = len(keys)
        self.first = np.cumsum(self.first)
        self.keys = np.concatenate([parts[s][1] for s in sorted(parts)]) if parts else np.zeros(0, _U64)
        self.size = np.zeros((depth, slices), _U64)  # places of a level, 0: none
        self.start = np.zeros((depth, slices), np.int64)  # first word of a level
        self.before = np.zeros((depth, slices), np.int64)  # number of the first key that a level numbers
        words, at = [], 0
        for s in sorted(parts):
            number = self.first[s]
            for k, level in enumerate(parts[s][0]):
                self.size[k, s], self.start[k, s], self.before[k, s] = 64 * len(level), at, number
                words.append(level)
                at += len(level)
                number += int(np.bitwise_count(level).sum())
        self.words = np.concatenate(words) if words else np.zeros(0, _U64)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.ranks = np.append(0, ones)  # set bits before each word
        listed = [i for s in sorted(parts) for i in range(self.first[s] + sum(int(np.bitwise_count(x).sum()) for x in parts[s][0]), self.first[s + 1])]
        self.listed = {int(self.keys[i]): i for i in listed}

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Number of every key; -1 if it is not one of the set (verified)."""
        keys = keys.astype(_U64)
        out = np.full(len(keys), -1, np.int64)
        of = slice_of(keys, self.slices)
        open_ = np.arange(len(keys))
        for k in range(len(self.size)):
            size = self.size[k, of[open_]]
            open_ = open_[size > 0]
            if not len(open_):
                break
            s = of[open_]
            place = _place(keys[open_], k, self.size[k, s])
            word = self.start[k, s] + (place >> 6)
            bit = (place & 63).astype(_U64)
            value = self.words[word]
            hit = (value >> bit) & _U64(1) == 1
            low = value & ((_U64(1) << bit) - _U64(1))
            found = open_[hit]
            rank = self.ranks[word[hit]] - self.ranks[self.start[k, s[hit]]] + np.bitwise_count(low[hit])
            out[found] = self.before[k, s[hit]] + rank
            open_ = open_[~hit]
        for i in open_.tolist() if self.listed else ():
            out[i] = self.listed.get(int(keys[i]), -1)
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)
