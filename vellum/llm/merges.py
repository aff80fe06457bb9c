"""Byte-pair merges of many words at once, in vectorised rounds.

All words lie in one flat array of symbols.  A round finds in each word the smallest rank among its
adjacent pairs, merges that pair in every word at the same time, and compacts the array; a word whose pairs have no
rank left leaves it.  All places of the smallest rank in a word (not overlapping, from the left) are merged in the same round
up to the first whose merge creates a pair of no larger rank, which would come before the places to its right.  A long word
that such places hold up is finished by a queue.  The results are those of a queue of merges ordered by rank, then place.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Words of more symbols go to the queue when a round merges only some of their places.
LONG = 256


class Merges:
    """Pairs (left, right) -> merged symbol, by rank; equal ranks go from left to right."""

    def __init__(self, left, right, rank, merged, symbols: int):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.rank, self.merged = np.append(np.asarray(rank, np.int32), NONE), np.append(np.asarray(merged, np.int64), -1)
        n = len(left)
        self.bits = max(8, int(n * 4).bit_length())
        self.table = np.full(1 << self.bits, n, np.int32)
        self.keys = np.append((left << 32 | right).astype(np.uint64), np.uint64(2**64 - 1))
        todo, slot, self.probes = np.arange(n), self._slot(self.keys[:n]), 0
        while len(todo):
            free = self.table[slot] == n
            self.table[slot[free]] = todo[free]
            lost = self.table[slot] != todo
            todo, slot = todo[lost], slot[lost] + 1 & (1 << self.bits) - 1
            self.probes += 1
        least = np.full(symbols, NONE, np.int32)
        for side in (left, right):
            np.minimum.at(least, side, self.rank[:n])
        self.safe = np.append(least[self.merged[:n]] > self.rank[:n], True)

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's index; the last index where there is no such pair."""
        n = len(self.keys) - 1
        key = (left << 32 | right).astype(np.uint64)
        slot = self._slot(key)
        got = self.table[slot]
        open_ = np.flatnonzero((got != n) & (self.keys[got] != key))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            got[open_] = again = self.table[slot[open_]]
            open_ = open_[(again != n) & (self.keys[again] != key[open_])]
        return got


def _creates_before(merges: Merges, sym, pair, hit, owner, first, lengths, which) -> np.ndarray:
    """For hits[which], merged from the left: does the merge create a pair of no larger rank than its own?"""
    at, word = hit[which], owner[which]
    made, rank = merges.merged[pair[at]], merges.rank[pair[at]]
    out = np.zeros(len(which), bool)
    # to the left stands what the hit before has made of it, if that one is next to this one
    left = np.flatnonzero(at > first[word])
    x = sym[at[left] - 1].copy()
    before = which[left] - 1
    near = np.flatnonzero((before >= 0) & (hit[before] == at[left] - 2) & (owner[before] == word[left]))
    x[near] = merges.merged[pair[hit[before[near]]]]
    out[left] = merges.rank[merges.find(x, made[left])] <= rank[left]
    right = np.flatnonzero(at + 2 < (first + lengths)[word])
    out[right] |= merges.rank[merges.find(made[right], sym[at[right] + 2])] <= rank[right]
    return out


def merge_queue(merges: Merges, symbols: np.ndarray) -> np.ndarray:
    """The same for one word, pair by pair from a queue: n log n steps for any word."""
    sym = symbols.tolist()
    n = len(sym)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    index = merges.find(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
    queue = [(r, i, x, y) for r, i, x, y in zip(merges.rank[index].tolist(), range(n), sym, sym[1:], strict=False) if r != NONE]
    heapq.heapify(queue)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def look(x: int, y: int) -> tuple[int, int]:
        if (x, y) not in known:
            k = merges.find(np.array([x]), np.array([y]))[0]
            known[x, y] = int(merges.rank[k]), int(merges.merged[k])
        return known[x, y]

    while queue:
        _, i, x, y = heapq.heappop(queue)
        j = after[i]
        if sym[i] != x or j < 0 or sym[j] != y:
            continue
        sym[i], sym[j] = look(x, y)[1], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := look(sym[i], sym[k])[0]) != NONE:
                heapq.heappush(queue, (r, i, sym[i], sym[k]))
        if (h := before[i]) >= 0 and (r := look(sym[h], sym[i])[0]) != NONE:
            heapq.heappush(queue, (r, h, sym[h], sym[i]))
    return np.array([x for x in sym if x >= 0], np.int64)


def merge_rounds(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """symbols: flat, of words with these lengths (each at least 1).  Returns the same after all merges."""
    lengths = lengths.astype(np.int64)
    done_sym, done_word, sizes = [], [], np.zeros(len(lengths), np.int64)
    word = np.arange(len(lengths))
    sym = symbols.astype(np.int64)
    pair = np.full(len(sym), len(merges.keys) - 1, np.int32)
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(sym), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    pair[at] = merges.find(sym[at], sym[at + 1])
    while len(sym):
        first = np.cumsum(lengths) - lengths
        rank = merges.rank[pair]
        least = np.minimum.reduceat(rank, first)
        if not (live := least != NONE).all():
            stay = np.repeat(live, lengths)
            done_sym.append(sym[~stay])
            done_word.append(word[~live])
            sizes[word[~live]] = lengths[~live]
            sym, pair, rank = sym[stay], pair[stay], rank[stay]
            word, lengths, least = word[live], lengths[live], least[live]
            if not len(sym):
                break
            first = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(lengths)), lengths)
        hit = np.flatnonzero(rank == least[of])
        owner = of[hit]
        lead = np.ones(len(hit), bool)
        lead[1:] = owner[1:] != owner[:-1]
        queued = None
        if len(hit) > len(lengths):
            # in a run of overlapping hits every second one counts, from the left
            start = lead
            start[1:] |= hit[1:] != hit[:-1] + 1
            begin = np.flatnonzero(start)
            place = np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))
            hit = hit[place % 2 == 0]
            owner = of[hit]
            if (unsafe := ~merges.safe[pair[hit]]).any():
                stop = np.flatnonzero(unsafe)
                stop = stop[_creates_before(merges, sym, pair, hit, owner, first, lengths, stop)]
                # in a word with such a place, the hits to its right wait
                until = np.full(len(lengths), len(hit))
                np.minimum.at(until, owner[stop], stop)
                wait = np.arange(len(hit)) > until[owner]
                held = np.zeros(len(lengths), bool)
                held[owner[wait]] = True
                held &= lengths > LONG
                hit, owner = hit[~wait], owner[~wait]
                queued = np.flatnonzero(held)
        if queued is not None and len(queued):
            for w in queued.tolist():
                out = merge_queue(merges, sym[first[w] : first[w] + lengths[w]])
                done_sym.append(out)
                done_word.append(word[w : w + 1])
                sizes[word[w]] = len(out)
            live = np.ones(len(lengths), bool)
            live[queued] = False
            stay = np.repeat(live, lengths)
            hit = (np.cumsum(stay) - 1)[hit[live[owner]]]
            sym, pair, word, lengths = sym[stay], pair[stay], word[live], lengths[live]
            owner = np.repeat(np.arange(len(lengths)), lengths)[hit]
        sym[hit] = merges.merged[pair[hit]]
        # the merged pair's right part goes; the pair that began there now begins at the merged symbol
        pair[hit] = pair[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))
        sym, pair = sym[keep], pair[keep]
        lengths = lengths - np.bincount(owner, minlength=len(lengths))
        ends = np.cumsum(lengths)
        right = at[at + 1 < ends[owner]]
        pair[right] = merges.find(sym[right], sym[right + 1])
        left = at[at > (ends - lengths)[owner]] - 1
        pair[left] = merges.find(sym[left], sym[left + 1])
    if not done_sym:
        return np.zeros(0, np.int64), sizes
    flat, order = np.concatenate(done_sym), np.concatenate(done_word)
    lens = sizes[order]
    from_ = np.cumsum(lens) - lens
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    lo, n = from_[back], lens[back]
    index = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
    return flat[index], sizes
