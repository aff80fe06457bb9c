"""Edit distances and alignments.

Short strings go through Spark's levenshtein.  Its time is the product of the lengths, so long strings and other sequences go
through an Arrow function on bit vectors, which handles 64 cells in a step.  Masks and back-traces have no built-in
either; masks are computed for a batch of pairs at a time along anti-diagonals, and back-traces read the bit vectors of the columns they
pass, so that neither holds a table of distances.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length from which bit vectors are faster.
LONG = 48


def edit_distance(a: Column, b: Column) -> Column:
    """Exact Levenshtein distance of two strings in code points."""
    long = (a != b) & (F.least(F.length(a), F.length(b)) > LONG)
    far = bit_distance(F.when(long, a), F.when(long, b))
    return F.when(a == b, F.lit(0)).when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).when(long, far.cast("int")).otherwise(F.levenshtein(a, b))


def within(a: Column, b: Column, k: int) -> Column:
    """Is the distance at most k?"""
    return (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b, k) >= 0)


def bits(x: Sequence, y: Sequence) -> int:
    """Levenshtein distance of two sequences: a column of the table is two vectors of bits, which say where it rises and falls."""
    if len(x) > len(y):
        x, y = y, x
    lo, hi = 0, len(x)
    while lo < hi and x[lo] == y[lo]:
        lo += 1
    cut = len(y) - len(x)
    while hi > lo and x[hi - 1] == y[hi - 1 + cut]:
        hi -= 1
    x, y = x[lo:hi], y[lo : hi + cut]
    if not len(x):
        return len(y)
    masks = Masks(x)
    full, last, score = masks.full, 1 << len(x) - 1, len(x)
    rise, fall = full, 0
    for v in y:
        rise, fall, up, low = _column(masks.of(v), rise, fall, full)
        if up & last:
            score += 1
        elif low & last:
            score -= 1
    return score


class Masks:
    """Where a sequence holds each of its values, as bits of one long integer; those of rare values are made when they are asked for."""

    def __init__(self, x: Sequence, often: int = 8):
        self.places: dict = {}
        for i, v in enumerate(x):
            self.places.setdefault(v, []).append(i)
        self.full = (1 << len(x)) - 1
        self.kept = {v: self._bits(p, len(x)) for v, p in self.places.items() if len(p) >= often}

    @staticmethod
    def _bits(places: list[int], n: int) -> int:
        on = bytearray((n + 7) // 8)
        for i in places:
            on[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(on, "little")

    def of(self, v) -> int:
        found = self.kept.get(v)
        return sum(1 << i for i in self.places.get(v, ())) if found is None else found


def _column(same: int, rise: int, fall: int, full: int) -> tuple[int, int, int, int]:
    """From one column of the table to the next: where it rises and falls downwards, and where it rises and falls from the column before."""
    across = (((same & rise) + rise) ^ rise) | same
    down = same | fall
    up, low = fall | (full & ~(across | rise)), rise & across
    a, b = up << 1 | 1, low << 1
    return (b | ~(down | a)) & full, a & down & full, up, low


#: Longest sequence, in blocks of 64, that advances together with others, if these are enough.
MOST_BLOCKS = 64
#: Bytes of the places of values, or of recorded columns, of pairs that advance together.
RECORD = 64 << 20


def _trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences without their common ends, the shorter first."""
    if len(x) > len(y):
        x, y = y, x
    n = len(x)
    apart = np.flatnonzero(x != y[:n])
    lo = int(apart[0]) if len(apart) else n
    x, y = x[lo:], y[lo:]
    apart = np.flatnonzero(x[::-1] != y[::-1][: len(x)])
    hi = len(x) - (int(apart[0]) if len(apart) else len(x))
    return x[:hi], y[: len(y) - (len(x) - hi)]


def _bands(m: np.ndarray, n: np.ndarray, part: int | None) -> tuple[np.ndarray, np.ndarray]:
    """How far from the diagonal (rows above, rows below) a path of x (m) and y (n, not fewer) goes that costs at most n // part + 16 more than n - m; None: any path.

    What is worked out inside a band is exact if it costs no more than that.
    """
    if part is None:
        return n, m
    more = (n // part + 16) // 2
    return n - m + more, more


def _groups(m: np.ndarray, n: np.ndarray, above: np.ndarray, below: np.ndarray, kinds: int, alone: tuple[float, float], together: int = 2048):
    """Places of pairs that advance together, by descending n, with the blocks that they record for a column; None: one that goes alone.

    alone: microseconds that a pair takes for a column by itself, and for each bit of it.
    """
    blocks = (m + 63) // 64
    wide = np.minimum((above + below) // 64 + 2, blocks)
    step = 1 << np.maximum(np.log2(np.maximum(wide, 1)).astype(np.int64) - 2, 0)
    wide = -(-wide // step) * step
    order = np.lexsort((-n, wide))
    lo = 0
    while lo < len(order):
        width = int(wide[order[lo]])
        each = (int(n[order[lo]]) + 1) * (width + 2) * 8 * kinds if kinds else 8 * int(blocks[order[lo]]) * int(m[order[lo]])
        hi = min(len(order), lo + max(1, min(together, RECORD // max(each, 1))), lo + int(np.searchsorted(wide[order[lo:]], width, "right")))
        some = order[lo:hi]
        all_ = int(n[some[0]]) * width * 18 * (0.7 + 0.0006 * len(some))
        apart = float((n[some] * (alone[0] + alone[1] * m[some])).sum())
        if blocks[some].max() > MOST_BLOCKS or blocks[some].max() > 8 and all_ > apart:
            yield from ((np.array([k]), True) for k in some)
        else:
            yield some, False
        lo = hi


def many_bits(pairs: Sequence[tuple[np.ndarray, np.ndarray]], together: int = 2048, part: int | None = 4) -> np.ndarray:
    """bits() of many pairs of integer arrays: pairs of like length advance together, one element of y at a time, first in a band around the diagonal, then those that left it over all rows."""
    short = [_trimmed(x, y) for x, y in pairs]
    m, out = (np.array([len(p[side]) for p in short], np.int64) for side in (0, 1))
    some = np.flatnonzero(m)
    m, n = m[some], out[some]
    above, below = _bands(m, n, part)
    left: list[int] = []
    for group, alone in _groups(m, n, above, below, 0, (1.1, 0.00027), together):
        at = some[group]
        if alone:
            out[at[0]] = bits(short[at[0]][0].tolist(), short[at[0]][1].tolist())
            continue
        out[at] = _advance([short[k] for k in at], int(above[group].max()), int(below[group].max()))
        if part is not None:
            left += at[out[at] > above[group] + below[group]].tolist()
    if left:
        out[left] = many_bits([short[k] for k in left], together, None)
    return out


def _encoded(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs by descending length of y: where each x holds each of its own values, in blocks of 64 bits; column by column the row of these that each element of y asks for; where columns begin."""
    one = np.uint64(1)
    m, n = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    symbols, x = np.unique(np.concatenate([x for x, _ in pairs]), return_inverse=True)
    row, at = np.repeat(np.arange(len(pairs)), m), np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    own, x = np.unique(row * (len(symbols) + 1) + x, return_inverse=True)
    same = np.zeros((int(m.max() + 63) // 64, len(own) + 1), np.uint64)
    np.bitwise_or.at(same.reshape(-1), (at >> 6) * (len(own) + 1) + x, one << (at & 63).astype(np.uint64))
    place = np.searchsorted(symbols, y := np.concatenate([y for _, y in pairs]))
    place[(place == len(symbols)) | (symbols[np.minimum(place, len(symbols) - 1)] != y)] = len(symbols)
    row, at = np.repeat(np.arange(len(pairs)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wanted = row * (len(symbols) + 1) + place
    place = np.searchsorted(own, wanted)
    place[own[np.minimum(place, len(own) - 1)] != wanted] = len(own)
    begin = np.append(0, np.cumsum(np.searchsorted(-n, -np.arange(int(n[0])), "left")))
    steps = np.empty(len(place), np.int64)
    steps[begin[at] + row] = place
    return same, steps, begin


def _window(columns: int, blocks: int, above: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of a band at each column from 0, and the one after its last."""
    j = np.arange(columns + 1)
    return np.maximum(j - above - 1, 0) >> 6, np.minimum(blocks, (np.maximum(j + below - 1, 0) >> 6) + 1)


def _advance(pairs: list[tuple[np.ndarray, np.ndarray]], above: int, below: int, columns: np.ndarray | None = None) -> np.ndarray:
    """Distances of pairs by descending length of y inside a band; the carries of a row pass from block to block as two bits.

    A block that leaves the band stays as it was, one that enters rises everywhere, and what passes below the last one that left rises by 1 a column: never less than the true distances.
    columns, if given, takes the vectors of _column() for each column from 1, (4, columns, blocks of the window, pairs).
    """
    one, top = np.uint64(1), np.uint64(63)
    same, steps, begin = _encoded(pairs)
    first, after = _window(len(begin) - 1, len(same), above, below)
    rise, fall = np.full((len(same), len(pairs)), ~np.uint64(0)), np.zeros((len(same), len(pairs)), np.uint64)
    for j in range(len(begin) - 1):
        asked = steps[begin[j] : begin[j + 1]]
        count, lo = len(asked), int(first[j + 1])
        plus, minus = one, np.uint64(0)
        for b in range(lo, int(after[j + 1])):
            eq, pv, mv = same[b][asked], rise[b, :count], fall[b, :count]
            down = eq | mv
            eq = eq | minus
            across = (((eq & pv) + pv) ^ pv) | eq
            up, low = mv | ~(across | pv), pv & across
            carry = up >> top, low >> top
            if columns is not None:
                columns[2, j + 1, b - lo, :count], columns[3, j + 1, b - lo, :count] = up, low
            up, low = up << one | plus, low << one | minus
            rise[b, :count], fall[b, :count] = low | ~(down | up), up & down
            if columns is not None:
                columns[0, j + 1, b - lo, :count], columns[1, j + 1, b - lo, :count] = rise[b, :count], fall[b, :count]
            plus, minus = carry
    # a last row is as far as its column, and every rise and fall down to it
    rows = np.clip(np.array([len(x) for x, _ in pairs]) - 64 * np.arange(len(same))[:, None], 0, 64).astype(np.uint64)
    inside = np.where(rows == 64, ~np.uint64(0), (one << (rows & top)) - one)
    rises, falls = (np.bitwise_count(v & inside).sum(axis=0, dtype=np.int64) for v in (rise, fall))
    return np.array([len(y) for _, y in pairs]) + rises - falls


@F.pandas_udf(T.LongType())
def bit_distance(x: pd.Series, y: pd.Series) -> pd.Series:
    """Levenshtein distances of two columns of strings or arrays; null where one is null."""
    on = [k for k, (a, b) in enumerate(zip(x, y, strict=True)) if a is not None and b is not None]
    if on and isinstance(x.iloc[on[0]], str):
        code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
        pairs = [(code(x.iloc[k]), code(y.iloc[k])) for k in on]
    else:
        pairs = _numbered([x.iloc[k] for k in on], [y.iloc[k] for k in on])
    out = pd.Series(pd.NA, index=range(len(x)), dtype="Int64")
    if on:
        out.iloc[on] = many_bits(pairs)
    return out


def _numbered(xs, ys) -> list[tuple[np.ndarray, np.ndarray]]:
    ids: dict = {}
    code = lambda s: np.array([ids.setdefault(v, len(ids)) for v in s], np.int64)
    return [(code(x), code(y)) for x, y in zip(xs, ys, strict=True)]


def distances(pairs: Sequence[tuple[np.ndarray, np.ndarray]], free: Sequence[np.ndarray] | None = None, cells: int = 1 << 16) -> np.ndarray:
    """Distances of pairs (x, y) of integer arrays; free[i] marks places of y whose column costs nothing.

    Cell (i, j) is the diagonal one where x[i] = y[j], else the least neighbour plus the cost of column j; the first
    column counts x, the first row sums costs.  Pairs of like length go together, a diagonal of all of them at a time.
    """
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]) + len(pairs[k][1]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (max(len(pairs[order[hi]][0]), 1)) < cells:
            hi += 1
        some = order[lo:hi]
        out[some] = _diagonals([pairs[k] for k in some], [free[k] for k in some] if free is not None else None)
        lo = hi
    return out


def _diagonals(pairs, free):
    """A diagonal is one contiguous piece of (place, pair) arrays of the narrowest integers that hold the distances."""
    count = len(pairs)
    n = np.array([len(x) for x, _ in pairs])
    m = np.array([len(y) for _, y in pairs])
    height, width = int(n.max()), int(m.max())
    symbols, at = np.unique(np.concatenate([v for pair in pairs for v in pair]), return_inverse=True)
    kind = np.int16 if max(height + width, len(symbols)) < 1 << 14 else np.int32 if max(height + width, len(symbols)) < 1 << 30 else np.int64
    # y and its costs run backwards, so that a diagonal meets them in ascending places, too
    x = np.full((height + 1, count), -1, kind)
    y = np.full((width + 1, count), -2, kind)
    cost = np.ones((width + 1, count), kind)
    lo = 0
    for k, (a, b) in enumerate(pairs):
        x[1 : len(a) + 1, k] = at[lo : lo + len(a)]
        y[width - len(b) : width, k] = at[lo + len(a) : lo + len(a) + len(b)][::-1]
        lo += len(a) + len(b)
        if free is not None:
            cost[width - len(b) : width, k] = ~free[k][::-1]
    cost[width] = 0
    top = np.cumsum(cost[::-1], axis=0, dtype=np.int64)
    out = np.where(n == 0, top[m, np.arange(count)], np.where(m == 0, n, -1))
    by_end = np.argsort(n + m, kind="stable")
    ends = np.searchsorted((n + m)[by_end], np.arange(height + width + 2))
    # diagonal d holds cells (i, d - i) at place i
    before, last, now = (np.zeros((height + 1, count), kind) for _ in range(3))
    one, two = (np.empty((height + 1, count), kind) for _ in range(2))
    for d in range(1, height + width + 1):
        a, b = max(1, d - width), min(height, d - 1)
        if a <= b:
            diagonal, least, same = before[a - 1 : b], one[a : b + 1], two[a : b + 1]
            np.minimum(last[a - 1 : b], last[a : b + 1], out=least)
            np.minimum(least, diagonal, out=least)
            least += cost[width - d + a : width - d + b + 1]
            # all bits where the elements are equal: there the diagonal, else the least
            np.bitwise_xor(x[a : b + 1], y[width - d + a : width - d + b + 1], out=same)
            np.minimum(same.view(f"u{same.itemsize}"), 1, out=same.view(f"u{same.itemsize}"))
            same -= 1
            diagonal = np.bitwise_xor(diagonal, least, out=now[a : b + 1])
            diagonal &= same
            diagonal ^= least
        if d <= width:
            now[0] = top[d]
        if d <= height:
            now[d] = d
        done = by_end[ends[d] : ends[d + 1]]
        done = done[(n[done] > 0) & (m[done] > 0)]
        out[done] = now[n[done], done]
        before, last, now = last, now, before
    return out


@F.pandas_udf(T.LongType())
def masked_distance(x: pd.Series, y: pd.Series, masks: pd.Series) -> pd.Series:
    """Distance of strings x and y where the places [off, off + len) of y cost nothing; null masks count as none."""
    free = []
    for b, spans in zip(y, masks, strict=True):
        f = np.zeros(len(b), bool)
        for s in [] if spans is None else spans:
            f[max(0, s["off"]) : max(0, s["off"] + s["len"])] = True
        free.append(f)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
    return pd.Series(distances([(code(a), code(b)) for a, b in zip(x, y, strict=True)], free))


#: Steps of a path through the table: both sides, only x, only y.
BOTH, UP, LEFT = range(3)


def paths(pairs: Sequence[tuple[np.ndarray, np.ndarray]], common: bool = False, part: int | None = 4) -> list[np.ndarray]:
    """The steps of each pair's back-trace, in order: diagonal where equal or least, then up, then left; common: that of a longest common subsequence.

    Short x advance together on bit vectors whose columns are recorded, first in a band around the diagonal, then those whose path leaves it over all rows.  A long x goes through its columns twice: first every
    few columns are kept, then, from the end, those between are made again, so that memory grows with the sequences and not with their product.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(pairs)
    cut, tail = [], np.zeros(len(pairs), np.int64)
    for k, (x, y) in enumerate(pairs):  # equal ends are diagonal steps
        n = min(len(x), len(y))
        apart = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        tail[k] = int(apart[0]) if len(apart) else n
        cut.append((x[: len(x) - tail[k]], y[: len(y) - tail[k]]))
    size = np.array([len(x) for x, _ in cut], np.int64)
    steps = np.array([len(y) for _, y in cut], np.int64)
    trivial = (size == 0) | (steps == 0)
    for k in np.flatnonzero(trivial):
        out[k] = np.full(size[k] + steps[k], UP if size[k] else LEFT, np.uint8)
    some = np.flatnonzero(~trivial)
    m, n = size[some], steps[some]
    above, below = _bands(np.minimum(m, n), np.maximum(m, n), part if part is None or not common else max(1, part // 2))
    above, below = np.where(m > n, below, above), np.where(m > n, above, below)
    left: list[int] = []
    for group, alone in _groups(m, n, above, below, 1 if common else 4, (2.5, 0.0006) if common else (3.5, 0.001)):
        at = some[group]
        if alone:
            out[at[0]] = _long_path(cut[at[0]][0].tolist(), cut[at[0]][1].tolist(), common)
            continue
        found, costs = _short_paths([cut[k] for k in at], int(above[group].max()), int(below[group].max()), common)
        for k, ops in zip(at, found, strict=True):
            out[k] = ops
        if part is not None:
            left += at[costs > above[group] + below[group]].tolist()
    if left:
        for k, ops in zip(left, paths([cut[k] for k in left], common, None), strict=True):
            out[k] = ops
    return [np.append(ops, np.zeros(t, np.uint8)) if t else ops for ops, t in zip(out, tail, strict=True)]


def _grow(pairs: list[tuple[np.ndarray, np.ndarray]], above: int, below: int, columns: np.ndarray) -> None:
    """The columns of lengths of common subsequences inside a band, never more than the true ones: bits are off where a column rises."""
    top = np.uint64(63)
    same, steps, begin = _encoded(pairs)
    first, after = _window(len(begin) - 1, len(same), above, below)
    flat = np.full((len(same), len(pairs)), ~np.uint64(0))
    for j in range(len(begin) - 1):
        asked = steps[begin[j] : begin[j + 1]]
        count, lo = len(asked), int(first[j + 1])
        carry = np.uint64(0)
        for b in range(lo, int(after[j + 1])):
            v = flat[b, :count]
            u = v & same[b][asked]
            total = v + u + carry
            carry = (v & u | (v | u) & ~total) >> top
            flat[b, :count] = columns[0, j + 1, b - lo, :count] = total | (v & ~u)


def _short_paths(pairs: list[tuple[np.ndarray, np.ndarray]], above: int, below: int, common: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Back-traces of pairs by descending length of y inside a band, a step of all of them at a time, and what they cost; those that leave the band cost more than any."""
    m, n = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    first, after = _window(int(n[0]), int(m.max() + 63) // 64, above, below)
    # a block that enters rises in the column before, too
    columns = np.empty((1 if common else 4, int(n[0]) + 1, int((after - first).max()) + 2, len(pairs)), np.uint64)
    columns[0] = ~np.uint64(0)
    if common:
        _grow(pairs, above, below, columns)
    else:
        columns[1] = 0
        _advance(pairs, above, below, columns)
    x, y = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    at_x, at_y = np.cumsum(m) - m, np.cumsum(n) - n
    i, j, live = m.copy(), n.copy(), np.arange(len(pairs))
    ops, done, costs = np.empty((int((m + n).max()), len(pairs)), np.uint8), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    step = 0
    while len(live):
        a, b = i[live], j[live]
        inside = ((a - 1) >> 6 >= first[b]) & ((a - 1) >> 6 < after[b])
        if not inside.all():
            costs[live[~inside]] = 1 << 62
            live, a, b = live[inside], a[inside], b[inside]
        block, place = (a - 1) >> 6, ((a - 1) & 63).astype(np.uint64)
        bit = lambda kind, column, block=block, place=place: (columns[kind, column, block - first[column], live] >> place & np.uint64(1)).astype(np.int8)  # noqa: B023, E731
        equal = x[at_x[live] + a - 1] == y[at_y[live] + b - 1]
        if common:
            op = np.where(equal, BOTH, np.where(bit(0, b) == 1, UP, LEFT))
        else:
            up, left = bit(1, b) - bit(0, b), bit(3, b) - bit(2, b)
            diagonal = left + bit(1, b - 1) - bit(0, b - 1)
            op = np.where(equal | (diagonal <= np.minimum(up, left)), BOTH, np.where(up <= left, UP, LEFT))
        ops[step, live] = op
        costs[live] += ~equal | (op != BOTH)
        i[live] -= op != LEFT
        j[live] -= op != UP
        step += 1
        ended = (i[live] == 0) | (j[live] == 0)
        done[live[ended]] = step
        live = live[~ended]
    costs += np.where(costs < 1 << 62, i + j, 0)
    return [np.concatenate([np.full(i[k] + j[k], UP if i[k] else LEFT, np.uint8), ops[: done[k], k][::-1]]) for k in range(len(pairs))], costs


def _long_path(x: list, y: list, common: bool) -> np.ndarray:
    """The back-trace of one pair in long integers."""
    masks = Masks(x)
    full, each = masks.full, max(1, math.isqrt(len(y)))

    def after(v, state: tuple[int, ...]) -> tuple[int, ...]:
        if not common:
            return _column(masks.of(v), state[0], state[1], full)
        u = state[0] & masks.of(v)
        return (((state[0] + u) | (state[0] & ~u)) & full,)

    state: tuple[int, ...] = (full,) if common else (full, 0, 0, 0)
    kept = [state]
    for k, v in enumerate(y[: (len(y) - 1) // each * each], 1):
        state = after(v, state)
        if k % each == 0:
            kept.append(state)
    ops = bytearray()
    i, j = len(x), len(y)
    while i and j:
        first = (j - 1) // each * each
        block = [kept[first // each]]
        for v in y[first:j]:
            block.append(after(v, block[-1]))
        while i and j > first:
            now, at = block[j - first], i - 1
            if x[at] == y[j - 1]:
                op = BOTH
            elif common:
                op = UP if now[0] >> at & 1 else LEFT
            else:
                before = block[j - first - 1]
                up, left = (now[1] >> at & 1) - (now[0] >> at & 1), (now[3] >> at & 1) - (now[2] >> at & 1)
                op = BOTH if left + (before[1] >> at & 1) - (before[0] >> at & 1) <= min(up, left) else UP if up <= left else LEFT
            ops.append(op)
            i, j = i - (op != LEFT), j - (op != UP)
    ops += bytes([UP]) * i + bytes([LEFT]) * j
    return np.frombuffer(bytes(ops), np.uint8)[::-1]


def places(ops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each step of a path: its place on either side, where it has one."""
    return np.cumsum(ops != LEFT) - 1, np.cumsum(ops != UP) - 1


def alignment(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of equal elements on the back-trace of the distance table: diagonal where equal or least, then up, then left."""
    return [(i, j) for i, j, a, b in edits(x, y) if a is not None and b is not None and a == b]


def edits(x: Sequence, y: Sequence) -> list[tuple[int, int, object, object]]:
    """The back-trace in order: (i, j, x[i], y[j]); None on the side that a deletion or an insertion lacks."""
    ops = paths(_numbered([x], [y]))[0]
    i, j = places(ops)
    return [(a + (op == LEFT), b + (op == UP), None if op == LEFT else x[a], None if op == UP else y[b]) for op, a, b in zip(ops.tolist(), i.tolist(), j.tolist(), strict=True)]


def common_subsequence(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    ops = paths(_numbered([x], [y]), common=True)[0]
    i, j = places(ops)
    return list(zip(i[ops == BOTH].tolist(), j[ops == BOTH].tolist(), strict=True))


PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
EDITS = T.ArrayType(T.StructType([T.StructField("gt", T.StringType()), T.StructField("pred", T.StringType()), T.StructField("n", T.LongType())]))


def _pairs_of(x: pa.Array, y: pa.Array, together: int = 4 << 20):
    """Parts of two columns of strings or arrays: (their rows without nulls, integer arrays, the values that the integers stand for)."""
    on = pc.and_(x.is_valid(), y.is_valid()).to_numpy(False)
    rows, text = np.flatnonzero(on), pa.types.is_string(x.type) or pa.types.is_large_string(x.type)
    size = np.cumsum([0, *(len(a) + len(b) for a, b in zip(x.take(pa.array(rows)).to_pylist(), y.take(pa.array(rows)).to_pylist(), strict=True))])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + together, "right")) - 1)
        some = pa.array(rows[lo:hi])
        xs, ys = x.take(some).to_pylist(), y.take(some).to_pylist()
        if text:
            code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
            yield rows[lo:hi], [(code(a), code(b)) for a, b in zip(xs, ys, strict=True)]
        else:
            yield rows[lo:hi], _numbered(xs, ys)
        lo = hi


def _lists(n: int, rows: list[np.ndarray], sizes: list[np.ndarray], fields: dict[str, pa.Array], valid: np.ndarray) -> pa.Array:
    """A column of lists of structs; rows not named are empty, or null where they are not valid."""
    count = np.zeros(n, np.int64)
    if rows:
        count[np.concatenate(rows)] = np.concatenate(sizes)
    at = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=pa.array(~valid))


def _aligned(x: pa.Array, y: pa.Array, common: bool) -> pa.Array:
    rows, sizes, one, two = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some, pairs in _pairs_of(x, y):
        n = []
        for (a, b), ops in zip(pairs, paths(pairs, common), strict=True):
            i, j = places(ops)
            on = ops == BOTH
            i, j = i[on], j[on]
            if not common:
                i, j = i[a[i] == b[j]], j[a[i] == b[j]]
            one.append(i), two.append(j), n.append(len(i))
        rows.append(some), sizes.append(np.array(n))
    fields = {k: pa.array(np.concatenate(v).astype(np.int32)) for k, v in (("i", one), ("j", two))}
    return _lists(len(x), rows, sizes, fields, pc.and_(x.is_valid(), y.is_valid()).to_numpy(False))


@F.arrow_udf(PAIRS)
def align(x: pa.Array, y: pa.Array) -> pa.Array:
    """alignment() of two strings or arrays; null where one is null."""
    return _aligned(x, y, False)


@F.arrow_udf(PAIRS)
def align_lcs(x: pa.Array, y: pa.Array) -> pa.Array:
    """common_subsequence() of two strings or arrays; null where one is null."""
    return _aligned(x, y, True)


#: Stands for the missing side of an insertion or a deletion; no code point.
NO_CHARACTER = 0x110000


@F.arrow_udf(EDITS)
def edit_counts(gt: pa.Array, pred: pa.Array) -> pa.Array:
    """Aligned characters of two strings and how often each pair occurs; null where the other side has none, and where one string is null."""
    rows, sizes, keys, times = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some, pairs in _pairs_of(gt, pred):
        n = []
        for (a, b), ops in zip(pairs, paths(pairs), strict=True):
            i, j = places(ops)
            left, right = (np.append(v, NO_CHARACTER)[np.where(ops == skip, len(v), at)] for v, at, skip in ((a, i, LEFT), (b, j, UP)))
            key, count = np.unique(left << 32 | right, return_counts=True)
            keys.append(key), times.append(count), n.append(len(key))
        rows.append(some), sizes.append(np.array(n))
    key, letters = np.concatenate(keys), {}
    for side, code in (("gt", key >> 32), ("pred", key & 0xFFFFFFFF)):
        values, index = np.unique(code, return_inverse=True)
        texts = pa.array([None if v == NO_CHARACTER else chr(v) for v in values.tolist()], pa.string())
        letters[side] = texts.take(pa.array(index.reshape(-1)))
    return _lists(len(gt), rows, sizes, letters | {"n": pa.array(np.concatenate(times))}, pc.and_(gt.is_valid(), pred.is_valid()).to_numpy(False))
