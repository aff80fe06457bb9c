"""Operator 7: document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last seven bytes; where its low bits are zero a chunk ends.  With block size 4 * 2**k, k + 2 bits
count, and k is the smallest for which at most 63 chunks end inside the text.  A fingerprint is `block:first:second:third`: a
base64 letter for each chunk at that block size, at twice and at four times that.  Two fingerprints are compared where
they have a block size in common: likeness is 1 - edit distance / longer length of the parts at that block size (the best such
if several), and 0 unless three letters in a row agree.

Documents are exchanged into ranges of their order, by exact counts of bytes; a range is passed over in order, and the
first document of the range that follows is its guest, so that the last one has its next.

Null texts count as empty, which have one chunk and all the same fingerprint; equal doc_ids follow the order of a hash of their
texts, descending, and may fill many ranges; null doc_ids come last; ids may lie as far apart as they can; repeated
rows are documents of their own; an empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.flat import SPREAD, U64, Rolling, flat, slices
from vellum.llm.shared import MB, cell_of, drop, order_key, ranges, written

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, MOST, RUN, PARTS = 7, 63, 3, 3
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Prints:
    """Fingerprints of many texts: level k, and letters (as numbers) at k, k + 1 and k + 2 in rows of 64."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        roll = Rolling(SPREAD[raw])
        at = np.arange(len(raw))
        start = np.repeat(offsets[:-1], np.diff(offsets))
        h = roll.of(np.maximum(at - WINDOW + 1, start), at + 1)
        at = at[(h & U64(3)) == 0]  # where a chunk ends at level 0
        h = h[at]
        self.level = np.full(n, -1)
        self.rows = np.zeros((PARTS, n, MOST + 1), np.uint8)
        self.size = np.zeros((PARTS, n), np.int64)
        k = 0
        while (self.level < 0).any() or (self.level >= k - PARTS + 1).any():
            doc = np.searchsorted(offsets, at, "right") - 1
            count = np.bincount(doc, minlength=n)
            self.level[(self.level < 0) & (count <= MOST)] = k
            for which in range(PARTS):
                mine = (self.level == k - which) & (self.level >= 0)
                if mine.any():
                    self._letters(which, mine, roll, offsets, at[mine[doc]], doc[mine[doc]], count)
            keep = (h >> U64(2 + k) & U64(1)) == 0
            at, h, k = at[keep], h[keep], k + 1

    def _letters(self, which, mine, roll, offsets, ends, doc, count):
        docs = np.flatnonzero(mine)
        size = count[docs] + 1
        self.size[which, docs] = size
        last = np.cumsum(size) - 1
        hi = np.empty(int(size.sum()), np.int64)
        inner = np.ones(len(hi), bool)
        inner[last] = False
        hi[inner], hi[last] = ends + 1, offsets[docs + 1]
        lo = np.empty_like(hi)
        lo[1:] = hi[:-1]
        lo[last - size + 1] = offsets[docs]
        row = np.repeat(docs, size)
        self.rows[which, row, np.arange(len(hi)) - np.repeat(last - size + 1, size)] = (roll.of(lo, hi) >> U64(58)).astype(np.uint8)

    def strings(self) -> list[str]:
        text = LETTERS[self.rows]
        return [":".join([str(4 << k), *(text[p, i, : self.size[p, i]].tobytes().decode() for p in range(PARTS))]) for i, k in enumerate(self.level.tolist())]


def edit_distance(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of numbers under 64 (lengths m and n, 1 to 64), by bit vectors for all rows at once."""
    rows = np.arange(len(a))
    one = U64(1)
    match = np.zeros((len(a), 64), U64)
    for i in range(int(m.max(initial=0))):
        on = rows[m > i]
        match[on, a[on, i]] |= one << U64(i)
    top = one << (m - 1).astype(U64)
    plus, minus, score = np.full(len(a), U64(2**64 - 1)), np.zeros(len(a), U64), m.astype(np.int64)
    for j in range(int(n.max(initial=0))):
        on = rows[n > j]
        eq, pv, mv = match[on, b[on, j]], plus[on], minus[on]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[on] += ((ph & top[on]) != 0).astype(np.int64) - ((mh & top[on]) != 0)
        ph, mh = ph << one | one, mh << one
        plus[on], minus[on] = mh | ~(xv | ph), ph & xv
    return score


def likeness(p: Prints, q: Prints, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Likeness, 0 to 1, of p's fingerprints left to q's fingerprints right."""
    out = np.zeros(len(left))
    step = q.level[right] - p.level[left]
    for a, b in np.ndindex(PARTS, PARTS):
        at = np.flatnonzero(step == a - b)
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            x, m, y, n = p.rows[a, left[some]], p.size[a, left[some]], q.rows[b, right[some]], q.size[b, right[some]]
            like = 1 - edit_distance(x, m, y, n) / np.maximum(m, n)
            like[~_share(x, m, y, n) & (like < 1)] = 0
            out[some] = np.maximum(out[some], like)
    return out


def _share(x, m, y, n) -> np.ndarray:
    """Which rows of x and y have RUN letters in a row in common."""

    def grams(v, size):
        g = sum(v[:, i : v.shape[1] - RUN + 1 + i].astype(np.int64) << 6 * i for i in range(RUN))
        fits = np.arange(g.shape[1]) + RUN <= size[:, None]
        return (np.arange(len(v))[:, None] << 6 * RUN | g)[fits]

    a, b = grams(x, m), grams(y, n)
    found = np.zeros(len(x), bool)
    found[a[np.isin(a, b)] >> 6 * RUN] = True
    return found


def fingerprint(texts: list[str]) -> list[str]:
    return Prints(*flat(pa.array(texts, pa.string()))).strings()


def compare(docs: DataFrame, range_bytes: int = 4 * MB, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts (second half from the next document in descending doc_id), and likenesses."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    docs = docs.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    keys = written(docs.select("key", (F.octet_length("text") + 1).cast("long").alias("size")), "keys")
    cuts = ranges(keys, range_bytes)
    # the first document of each range, in this order; a row for each range that has any
    heads = sorted(keys.groupBy(cell_of(cuts, F.col("key")).alias("range")).agg(F.max("key").alias("head")).collect(), key=lambda r: r["range"])
    drop(keys)
    cuts = [cuts[r["range"] - 1] for r in heads[1:]]
    n, width = len(cuts) + 1, len(heads[0]["head"]) if heads else 1
    table = F.lit(b"".join(bytes(r["head"]) for r in heads))
    docs = in_ranges_with_guests(docs, cuts, F.substring(table, cell_of(cuts, F.col("key")) * width + 1, F.lit(width)) == F.col("key"), n)

    def run(batches):
        names, texts, done = [], [], False
        for batch in batches:
            for part in slices(batch, "text"):
                if done:
                    continue
                guest = part.column("guest").to_numpy(zero_copy_only=False)
                done = bool(guest.any())
                own = int(guest.argmax()) if done else part.num_rows
                names.append(part.column("doc_id").slice(0, own))
                texts += part.column("text").slice(0, own + done).to_pylist()
                ready = len(texts) - 1
                if ready:
                    ids = pa.concat_arrays(names)
                    yield _compare(ids.slice(0, ready), texts)
                    names, texts = [ids.slice(ready)], texts[-1:]

    return docs.sortWithinPartitions("guest", F.desc("key"), F.desc("text")).select("doc_id", "text", "guest").mapInArrow(run, SCHEMA)


def in_ranges_with_guests(docs: DataFrame, cuts: list[bytes], head: Column, n: int) -> DataFrame:
    """docs in ranges; the rows for which head holds are guests of the next range, too (the last range's of the first)."""
    own = F.struct(cell_of(cuts, F.col("key")).alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(((cell_of(cuts, F.col("key")) + 1) % n).cast("int").alias("range"), F.lit(True).alias("guest"))
    both = docs.withColumn("to", F.explode(F.when(head, F.array(own, guest)).otherwise(F.array(own))))
    return both.select("doc_id", "text", "key", "to.range", "to.guest").repartitionById(n, "range")


def _compare(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Rows of the documents but the last, each with the next one."""
    edited = []
    for a, b in zip(texts[:-1], texts[1:], strict=True):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    p = Prints(*flat(pa.array(texts, pa.string())))
    q = Prints(*flat(pa.array(edited, pa.string())))
    i = np.arange(len(edited))
    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "n_chars": pa.array([len(x) for x in texts[:-1]], pa.int64()), "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
        "fingerprint": p.strings()[:-1], "edited_fingerprint": q.strings(), "near_edited": likeness(p, q, i, i), "near_next": likeness(p, p, i, i + 1),
    })
