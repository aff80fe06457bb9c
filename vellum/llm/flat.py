"""numpy primitives over many texts in one flat byte array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII white space that separates words: space, \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(0x5EED)
#: A random value for each byte, so that polynomial hashes start from well spread values.
SPREAD = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = 2 << 20):
    """Parts of a batch with about `most` bytes of text each; one row is never split."""
    _, at = flat(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


HELD = 1 << 20  # powers that are kept from one call to the next
_held: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = _held.get(base)
    if out is None or len(out) < n:
        size = max(n, 1 << 18)
        out = np.ones(size, U64)
        done, b = 1, base & (1 << 64) - 1
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U64(pow(b, done, 1 << 64))
            done += take
        out.flags.writeable = False
        if size <= HELD:
            _held[base] = out
    return out[:n]


class Rolling:
    """Hashes of any slices of a sequence of 64-bit values in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.back = powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93))

    def each(self, width: int) -> np.ndarray:
        """The hashes of all slices of this width, by place."""
        n = max(0, len(self.sums) - width)
        out = self.sums[width:] - self.sums[:n]
        out *= self.back[:n]
        out += U64(width * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        return mix(out)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text the number of words before it."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~BLANK[raw]
    first = np.ones(n, bool)
    first[1:] = ~ink[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = True
    starts = np.flatnonzero(ink & first)
    last = np.ones(n, bool)
    last[:-1] = ~ink[1:]
    last[cut[cut > 0] - 1] = True
    ends = np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive runs of these lengths: each element's run and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather(lo: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices lo[0] .. lo[0]+lengths[0]-1, lo[1] .. and so on."""
    total = int(lengths.sum())
    out = np.arange(total)
    out += np.repeat(lo - (np.cumsum(lengths) - lengths), lengths)
    return out


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of 0 .. n-1 lie in any of [lo, hi)."""
    steps = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def strings(raw: np.ndarray, starts: np.ndarray, end: int) -> pa.BinaryArray:
    """The slices between consecutive starts as an Arrow array, without a copy."""
    at = np.append(starts, end)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i+width]) for each i where it fits, by doubling."""
    if width > len(x):
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x
