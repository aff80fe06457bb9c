"""How many elements two sequences have in common: on the back-trace of their distances, and in a longest common subsequence.

Counts need no lists of places.  Pairs advance together on bit vectors that move along the diagonal, in bands wide enough for all best paths: how often values occur on either side bounds
what a path costs from below, and every step away from the diagonals of both ends adds to it.  A guess is tried first; what a pair costs there says whether the band was wide enough, and
how wide one is that surely is.  Long pairs, of which there are few, go alone on long integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.distance import Masks

#: Bytes of the columns that are recorded at a time, and pairs that advance together at most.
RECORD, TOGETHER = 48 << 20, 2048
#: Microseconds that a group takes for a column, for each word in it, and for each word of each pair; that a pair alone takes for a column, and for each word; bytes of a word that are recorded.
MATCHES, COMMON = (22, 10, 0.035, 1.4, 0.015, 16), (9, 3, 0.012, 1.1, 0.01, 0)
#: Columns between which the number of pairs stays as it is.
STRETCH = 16
_ALL = ~np.uint64(0)
COUNTS = T.StructType([T.StructField("n_aligned", T.IntegerType()), T.StructField("n_lcs", T.IntegerType())])
# an array costs a function less than a number that it has to make one of
_SHIFT = [np.array(k, np.uint64) for k in range(64)]
_ONE, _63 = _SHIFT[1], _SHIFT[63]
_add, _and, _or, _xor, _not, _left, _right = np.add, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert, np.left_shift, np.right_shift


def counts(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of integer arrays: how many equal elements are on the path of distance.paths(), and the length of a longest common subsequence."""
    size = np.array([[len(v) for v in p] for p in pairs], np.int64).reshape(-1, 2)
    return _counts(*(np.concatenate([np.zeros(0, np.int64), *(p[side] for p in pairs)]) for side in (0, 1)), *size.T)


def _counts(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts() of pairs that stand one after the other in x and y, and how long they are.

    Equal elements of a path are a common subsequence, and none is longer than all that either side has of the other's elements; only where these differ is it looked for.
    """
    equal, most = np.zeros((2, len(m)), np.int64)
    some = np.flatnonzero((m > 0) & (n > 0))
    if len(some):
        x, y, kinds = _dense(x, y)
        one, two = _surplus(x, y, m, n)
        pairs = [(x[a:b], y[c:d]) for (a, b), (c, d) in zip(_spans(m), _spans(n), strict=True)]
        pairs, m, n, one, two = [pairs[k] for k in some], m[some], n[some], one[some], two[some]
        least, apart = np.maximum(one, two), np.abs(n - m)
        # a path that leaves a band of w bits goes up and left w times or more; one that goes up (left) u times costs u more than the elements that y (x) has more than the other side
        needed = lambda cost, k: np.minimum(cost[k], apart[k] + 2 * (cost[k] - least[k])) + 1
        found = _counted(pairs, m, n, kinds, least + (least >> 5) + 8, needed, _matches, _long_matches, MATCHES)
        equal[some] = most[some] = found
        rest = np.flatnonzero(found < m - one)
        most[some[rest]] = _counted([pairs[k] for k in rest], m[rest], n[rest], kinds, (one + two + (one + two >> 4))[rest], lambda cost, k: cost[k] + 1, _common, _long_common, COMMON)
    return equal, most


def _spans(size: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(size).tolist()
    return zip([0, *ends], ends, strict=False)


def _counted(pairs, m: np.ndarray, n: np.ndarray, kinds: int, cost: np.ndarray, needed, together, alone, price: tuple[float, ...]) -> np.ndarray:
    """What together() and alone() count, in bands of the bits that are needed, so that all best paths are inside: first for a guess of the costs, then for those that were found."""
    out, cost = np.zeros(len(pairs), np.int64), cost.copy()
    left = np.arange(len(pairs))
    while len(left):
        words = (needed(cost, left) - 1) // 64 + 1
        for group, width in _groups(words, n[left], price, kinds):
            at = left[group]
            if width:
                words[group] = width
                out[at], cost[at] = together([pairs[k] for k in at], m[at], n[at], width, kinds)
            else:
                out[at], cost[at] = alone(*pairs[at[0]], int(words[group[0]]) * 64)
        left = left[needed(cost, left) > words * 64]
    return out


def _dense(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both with their values numbered from 0, and how many there are."""
    low, high = min(int(x.min()), int(y.min())), max(int(x.max()), int(y.max()))
    if high - low >= max(1 << 21, len(x) + len(y)):
        seen, both = np.unique(np.concatenate([x, y]), return_inverse=True)
        return both[: len(x)], both[len(x) :], len(seen)
    seen = np.zeros(high - low + 1, np.int32)
    for v in (x, y):
        seen[v - low] = 1
    number = np.cumsum(seen, dtype=np.int32) - 1
    return number[x - low], number[y - low], int(number[-1]) + 1


def _surplus(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, bins: int = 128, together: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of each side the other one lacks, whatever their order; values of one bin count as equal."""
    one, two = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
    ends = [np.append(0, np.cumsum(size)) for size in (m, n)]
    lo = 0
    while lo < len(m):
        hi = max(lo + 1, min(lo + 1024, int(np.searchsorted(sum(ends), ends[0][lo] + ends[1][lo] + together, "right")) - 1))
        count = []
        for v, size, at in ((x, m, ends[0]), (y, n, ends[1])):
            row = np.repeat(np.arange(hi - lo) * bins, size[lo:hi])
            row += v[at[lo] : at[hi]] & bins - 1
            count.append(np.bincount(row, minlength=(hi - lo) * bins).reshape(-1, bins))
        more = count[0] - count[1]
        one[lo:hi] = np.maximum(more, 0).sum(axis=1)
        two[lo:hi] = one[lo:hi] - more.sum(axis=1)
        lo = hi
    return one, two


def _groups(words: np.ndarray, n: np.ndarray, price: tuple[float, ...], kinds: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places of pairs that advance together, by descending n, the words of their band); 0 words: one that goes alone.

    Pairs of few words may go with those of the next wider bands, in the way that is cheapest.
    """
    step = 1 << np.maximum(np.log2(words).astype(np.int64) - 2, 0)
    wide = -(-words // step) * step
    widths = np.unique(wide).tolist()
    order = np.lexsort((-n, wide))
    ends = np.searchsorted(wide[order], widths, "right").tolist()
    best: list[tuple[float, list]] = [(0.0, [])]
    for k, width in enumerate(widths):
        ways = []
        for j in range(max(0, k - 5), k + 1):
            group = order[ends[j - 1] if j else 0 : ends[k]]
            cost, parts = _cut(group[np.argsort(-n[group], kind="stable")], words, n, width, price, kinds)
            ways.append((best[j][0] + cost, best[j][1] + [parts]))
        best.append(min(ways, key=lambda w: w[0]))
    return (part for parts in best[-1][1] for part in parts)


def _cut(group: np.ndarray, words: np.ndarray, n: np.ndarray, width: int, price: tuple[float, ...], kinds: int) -> tuple[float, list[tuple[np.ndarray, int]]]:
    """Pairs by descending n as groups of one width, the first ones alone where that is cheaper, and what they cost."""
    column, wider, word, lone, lone_word, recorded = price
    n, column = n[group], column + wider * width
    apart = np.append(0, np.cumsum(n * (lone + lone_word * words[group])))
    rest = np.append(np.cumsum(n[::-1])[::-1], 0) * word * width
    k = max(int(np.argmin(apart + rest + column * np.append(n, 0))), int(np.searchsorted(-n, -RECORD // (recorded * width + 16))))
    cost, out = apart[k] + rest[k], [(group[i : i + 1], 0) for i in range(k)]
    while k < len(group):
        cost += column * n[k]
        hi = k + max(1, min(TOGETHER, RECORD // (int(n[k]) * (recorded * width + 16)), (4 << 20) // kinds))
        out.append((group[k:hi], width))
        k = hi
    return float(cost), out


def _encoded(pairs: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray, n: np.ndarray, above: np.ndarray, width: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each x holds each of its own values, in words of 64 bits, its row i (from 1) at bit i + above; for each column the one of these that each y asks for."""
    row = np.repeat(np.arange(len(pairs)), m)
    key = row * kinds + np.concatenate([x for x, _ in pairs])
    seen = np.zeros(len(pairs) * kinds, bool)
    seen[key] = True
    own = np.cumsum(seen) - 1
    none = int(own[-1]) + 1
    own[~seen] = none
    words = (int(n[0]) + 64 * width >> 6) + 2
    same = np.zeros((words, none + 1), np.uint64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m - above - 1, m)
    # each bit once, so that a sum will do
    np.add.at(same.reshape(-1), (at >> 6) * (none + 1) + own[key], np.uint64(1) << (at & 63).astype(np.uint64))
    asked = np.full((len(pairs), int(n[0]) + 1), none, np.int32)
    places = np.arange(int(n[0]) + 1)
    asked[(places > 0) & (places <= n[:, None])] = own[np.repeat(np.arange(len(pairs)) * kinds, n) + np.concatenate([y for _, y in pairs])]
    return same, np.ascontiguousarray(asked.T)


def _stretches(n: np.ndarray) -> list[tuple[int, int, int]]:
    """(first column, the one after the last, pairs that have columns there) of pairs by descending n."""
    out = []
    for j in range(0, int(n[0]) + 1, STRETCH):
        lo, hi = max(j, 1), min(int(n[0]) + 1, j + STRETCH)
        if lo < hi:
            out.append((lo, hi, int(np.searchsorted(-n, -lo, "right"))))
    return out


def _carry(total: np.ndarray, term: np.ndarray) -> None:
    """Carries of a sum of long integers from word to word; term: one of its two."""
    over = total < term
    if len(total) > 2:
        full = total == _ALL
        for w in range(1, len(total) - 1):
            over[w] |= full[w] & over[w - 1]
    _add(total[1:], over[:-1], total[1:])


def _from(above: np.ndarray, width: int) -> np.ndarray:
    """All bits from `above` on."""
    at = above - 64 * np.arange(width)[:, None]
    return np.where(at >= 64, np.uint64(0), _ALL << np.clip(at, 0, 63).astype(np.uint64))


def _bit(at: np.ndarray, width: int) -> np.ndarray:
    """The bit `at` alone."""
    at = at - 64 * np.arange(width)[:, None]
    return np.where((at >= 0) & (at < 64), np.uint64(1) << (at & 63).astype(np.uint64), np.uint64(0))


def _above(m, n, bits: int):
    """How many diagonals of a band of so many bits are above that of the first cell, so that as many paths leave it on either side."""
    return (bits - 1 + n - m) >> 1


def _matches(pairs, m: np.ndarray, n: np.ndarray, width: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal elements on the back-traces of pairs by descending n in bands of 64 * width bits, and what the paths cost there.

    Bit p of column j is row j - above + p.  Rows before the first cost as much as their column, and cells outside cost more than they do, so that best paths inside are found as
    they are.  Two bits of a cell are recorded: whether it is equal or the way is up, and whether the way is up or left.
    """
    above = _above(m, n, 64 * width)
    same, asked = _encoded(pairs, m, n, above, width, kinds)
    count = len(pairs)
    rise, fall = _from(above, width), np.zeros((width, count), np.uint64)
    kept = np.empty((2, int(n[0]) + 1, width, count), np.uint64)
    stretches = _stretches(n)
    eq, old = None, -1
    for lo, hi, count in stretches:
        rows = same[lo >> 6 : (lo >> 6) + width + 1]
        if count != old:
            rise, fall, old = np.ascontiguousarray(rise[:, :count]), np.ascontiguousarray(fall[:, :count]), count
            found, (eq, part, total, up) = np.empty((width + 1, count), np.uint64), np.empty((4, width, count), np.uint64)
            low, high, bit = found[:-1], found[1:], np.empty((width - 1, count), np.uint64)
        steps = asked[lo:hi, :count].astype(np.intp)
        for j in range(lo, hi):
            rows.take(steps[j - lo], 1, found, "clip")
            if j & 63:
                _right(low, _SHIFT[j & 63], eq)
                _left(high, _SHIFT[-(j & 63)], part)
                _or(eq, part, eq)
            else:
                eq[:] = low
            _and(eq, rise, part)
            _add(part, rise, total)
            if width > 1:
                _carry(total, part)
            _xor(total, rise, total)
            _or(total, eq, total)
            # where the row rises and falls from the column before
            _or(total, rise, up)
            _not(up, up)
            _or(up, fall, up)
            _and(rise, total, total)
            stay, ways = kept[0, j, :, :count], kept[1, j, :, :count]
            _add(total, total, part)
            if width > 1:
                _right(total[:-1], _63, bit)
                _or(part[1:], bit, part[1:])
            _or(part, eq, stay)
            _or(stay, fall, part)
            _xor(part, eq, ways)
            # the next column is a row further down
            _or(eq, fall, eq)
            _right(eq, _ONE, part)
            if width > 1:
                _left(eq[1:], _63, bit)
                _or(part[:-1], bit, part[:-1])
            _and(part, up, fall)
            _or(part, up, part)
            _not(part, part)
            _or(total, part, rise)
    first = _bit(above - n + m, width)
    now, ups, equal = np.zeros_like(first), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    began, begun = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "right").tolist(), 0
    for lo, hi, count in reversed(stretches):
        here = now[:, :count].copy()
        seen, (up, part) = np.empty((hi - lo, width, count), np.uint64), np.empty((2, width, count), np.uint64)
        each, ways_up, flat = here.reshape(-1), up.reshape(-1), part.reshape(-1)
        for j in range(hi - 1, lo - 1, -1):
            if began[j] > begun:
                here[:, begun : began[j]] = first[:, begun : began[j]]
                begun = began[j]
            stay, ways = kept[0, j, :, :count], kept[1, j, :, :count]
            _and(stay, ways, up)
            _and(up, here, part)
            (moved,) = flat.nonzero()
            while len(moved):
                ups[moved % count] += 1
                value = each[moved] >> _ONE
                each[moved] = value
                if width > 1 and not value.all():  # to the last bit of the word before
                    moved = moved - np.where(value == 0, count, 0)
                    value[value == 0] = np.uint64(1 << 63)
                    each[moved] = value
                moved = moved[(ways_up[moved] & value) != 0]
            _and(here, stay, seen[j - lo])
            _and(here, ways, part)
            _add(here, part, here)
            if width > 1:
                _right(part, _63, part)
                _or(here[1:], part[:-1], here[1:])
        now[:, :count] = here
        equal[:count] += np.bitwise_count(seen).sum(axis=(0, 1), dtype=np.int64)
    place = np.where(now > 0, np.bitwise_count(now - (now > 0)) + 64 * np.arange(width)[:, None], 0).sum(axis=0)
    cost = n - equal + ups + np.maximum(place - above, 0)
    return equal, np.where((now > 0).any(axis=0), cost, np.maximum(m, n))


def _common(pairs, m: np.ndarray, n: np.ndarray, width: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of longest common subsequences of pairs by descending n in bands of 64 * width bits or somewhat more, and how many elements are not in them; bits are off where a column rises."""
    same, asked = _encoded(pairs, m, n, _above(m, n, 64 * width), width, kinds)
    flat, old = np.full((len(same), len(pairs)), _ALL), -1
    for lo, hi, count in _stretches(n):
        rows, here = same[lo >> 6 : (lo >> 6) + width + 1], flat[lo >> 6 : (lo >> 6) + width + 1, :count]
        if count != old:
            (found, total), old = np.empty((2, width + 1, count), np.uint64), count
        steps = asked[lo:hi, :count].astype(np.intp)
        for j in range(lo, hi):
            rows.take(steps[j - lo], 1, found, "clip")
            _and(found, here, found)
            _add(found, here, total)
            _carry(total, found)
            _xor(here, found, here)
            _or(here, total, here)
    length = np.bitwise_count(~flat).sum(axis=0, dtype=np.int64)
    return length, m + n - 2 * length


def _windows(x: np.ndarray, y: np.ndarray, bits: int, above: int, first: int, after: int) -> Iterator[tuple[list[int], dict[int, int], int]]:
    """(values of y in some columns after `first` up to `after`, where x holds them as bits, the shift for the first column): bit p of column j is row j - above + p; a column shifts by one more."""
    each = max(1024, 2 * bits)
    for lo in range(first, after, each):
        hi, begin = min(lo + each, after), max(0, lo - above)  # the first row that is needed, from 0
        near, part = x[begin : max(begin, hi - above + bits)], y[lo:hi]
        kinds = np.unique(part).tolist()
        if len(kinds) < 256:
            where = {v: int.from_bytes(np.packbits(near == v, bitorder="little").tobytes(), "little") for v in kinds}
        else:
            masks = Masks(near.tolist())
            where = {v: masks.of(v) for v in kinds}
        skip = lo - above - begin
        if skip < 0:  # rows before the first
            where, skip = {v: mask << -skip for v, mask in where.items()}, 0
        yield part.tolist(), where, skip


def _trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Two sequences without their equal ends, and how long those are."""
    k = min(len(x), len(y))
    apart = np.flatnonzero(x[len(x) - k :][::-1] != y[len(y) - k :][::-1])
    k = int(apart[0]) if len(apart) else k
    return x[: len(x) - k], y[: len(y) - k], k


def _long_matches(x: np.ndarray, y: np.ndarray, bits: int) -> tuple[int, int]:
    """_matches() of one pair in long integers; as many columns as fit are recorded, those before are made again on the way back."""
    above, full = _above(len(x), len(y), bits), (1 << bits) - 1
    p = above - len(y) + len(x)
    x, y, tail = _trimmed(x, y)
    each = max(256, RECORD * 4 // (bits + 320))  # two numbers a column, with what Python keeps of each

    def advanced(first: int, after: int, rise: int, fall: int, kept: tuple[list, list] | None) -> tuple[int, int]:
        for values, where, at in _windows(x, y, bits, above, first, after):
            for at, v in enumerate(values, at):
                eq = where[v] >> at & full
                total = (eq & rise) + rise ^ rise | eq
                up = (total | rise) ^ full | fall
                total &= rise
                if kept is not None:
                    stay = total << 1 | eq
                    kept[0].append(stay)
                    kept[1].append((stay | fall) ^ eq)
                part = (eq | fall) >> 1
                rise, fall = (part | up) & full ^ full | total, part & up
        return rise, fall

    parts = [(lo, min(lo + each, len(y))) for lo in range(0, len(y), each)] or [(0, 0)]
    states = [(full >> above << above, 0)]
    for lo, hi in parts[:-1]:
        states.append(advanced(lo, hi, *states[-1], None))
    equal = ups = 0
    for (lo, hi), state in zip(reversed(parts), reversed(states), strict=True):
        kept: tuple[list, list] = ([], [])
        advanced(lo, hi, *state, kept)
        while kept[0]:
            stay, ways = kept[0].pop(), kept[1].pop()
            one, two = stay >> p & 1, ways >> p & 1
            while one and two:
                p, ups = p - 1, ups + 1
                one, two = stay >> p & 1, ways >> p & 1
            equal += one
            p += two
            if p == bits:  # it leaves the band
                return 0, max(len(x), len(y))
    return equal + tail, len(y) - equal + ups + max(p - above, 0)


def _long_common(x: np.ndarray, y: np.ndarray, bits: int) -> tuple[int, int]:
    """_common() of one pair in long integers."""
    above, size = _above(len(x), len(y), bits), len(x) + len(y)
    x, y, tail = _trimmed(x, y)
    flat, last, length = (1 << bits) - 1, 1 << bits - 1, 0
    for values, where, at in _windows(x, y, bits, above, 0, len(y)):
        for at, v in enumerate(values, at):
            eq = where[v] >> at & flat
            flat = flat + eq | flat ^ eq
            length += flat & 1 ^ 1
            flat = flat >> 1 | last
    length += bits - (flat & (last << 1) - 1).bit_count() + tail
    return length, size - 2 * length


def _of_texts(x: pa.Array, y: pa.Array, characters: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows without nulls, their counts()) of two columns of strings, so many characters at a time."""
    on = pc.and_(x.is_valid(), y.is_valid())
    rows, x, y = np.flatnonzero(on.to_numpy(False)), x.filter(on), y.filter(on)
    m, n = (pc.utf8_length(v).to_numpy(False).astype(np.int64) for v in (x, y))
    size, lo = np.cumsum(m + n), 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + characters, "right")))
        yield rows[lo:hi], *_counts(_characters(x.slice(lo, hi - lo)), _characters(y.slice(lo, hi - lo)), m[lo:hi], n[lo:hi])
        lo = hi


def _characters(x: pa.Array) -> np.ndarray:
    """The code points of all strings, one after the other."""
    return np.frombuffer("".join(x.to_pylist()).encode("utf-32-le"), np.int32)


@F.arrow_udf(COUNTS)
def alignment_counts(x: pa.Array, y: pa.Array) -> pa.Array:
    """The sizes of distance.align() and distance.align_lcs() of two strings; null where one is null."""
    out = np.zeros((2, len(x)), np.int32)
    for rows, *found in _of_texts(x, y):
        out[:, rows] = found
    null = pc.invert(pc.and_(x.is_valid(), y.is_valid()))
    return pa.StructArray.from_arrays([pa.array(v) for v in out], COUNTS.names, mask=null)
