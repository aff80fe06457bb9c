"""Operator 2: removal of repeated 13-word windows by super-k-mer partitioning.

Each window of `width` consecutive words has a minimiser, the three words of smallest hash in it.  Consecutive
windows that share it travel as one packed string to the minimiser's bucket, with the smallest and the largest doc_id that hold
the string in the chunk (equal hashes of strings are compared byte by byte); chunks first ask which minimisers occur
twice or more, and strings of the others, whose windows are unique, stay.  A bucket sorts all its windows, so that equal ones meet, and finds the smallest doc_id of each; a
word is removed if a window that covers it also starts in a document with a smaller doc_id.

A minimiser that occurs very often, such as a common phrase, is no bucket of its own: its super-k-mers are cut by where it lies in the windows, and each
part is dealt by the words that all its windows share around it.  The more often it occurs, the more parts, up to a part for each place, which is
dealt by all the window's words.  Equal windows have the minimiser in the same place and share all words, so they still meet.

Null and empty texts have no words; texts of fewer than `width` words lose none; rows with the same doc_id do not
remove each other's words; a null doc_id is neither smaller nor larger than any; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.flat import SPREAD, U64, Rolling, covered, flat, gather, spans, strings, words
from vellum.llm.routing import Routing, bucket_of, cut, minimisers, ordered, pack, repeated_and_frequent, runs, table, unpack
from vellum.llm.routing import groups as _groups
from vellum.llm.shared import MB

MINIMISER = 3
#: Times that a minimiser may occur before its super-k-mers are cut, and the parts they are cut into first (routing.parts_of).
HOT, PARTS = 1 << 14, (2, 4, 11)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_hashes(raw: np.ndarray, ws: np.ndarray, we: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Hashes of words, some at a time, so that no array of 64-bit values spans all bytes."""
    out = np.empty(len(ws), U64)
    for lo in range(0, len(ws), block):
        a, b = ws[lo : lo + block], we[lo : lo + block]
        out[lo : lo + block] = Rolling(SPREAD[raw[a[0] : b[-1]]]).of(a - a[0], b - a[0])
    return out


class _Chunk:
    """A chunk's words (each followed by one blank) and its super-k-mers; `frequent` are minimisers, ascending, and the parts into which theirs are cut."""

    def __init__(self, group: pa.Table, width: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        group = ordered(group)
        self.ids = group["doc_id"].combine_chunks()
        raw, offsets = flat(group["text"])
        ws, we, self.before = words(raw, offsets)
        self.n = len(ws)
        size = we - ws
        self.start = np.append(0, np.cumsum(size + 1))
        self.raw = np.full(self.start[-1], 0x20, np.uint8)
        self.raw[gather(self.start[:-1], size)] = raw[gather(ws, size)]
        roll = word_hashes(raw, ws, we)
        counts = np.diff(self.before)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        counts = np.where(self.ids.is_valid().to_numpy(zero_copy_only=False), counts, 0)
        found = [_pieces(roll[self.before[lo] : self.before[hi]], self.before[lo : hi + 1] - self.before[lo], counts[lo:hi], width, frequent) for lo, hi in blocks(self.before, 1 << 16)]
        base = np.repeat(np.array([self.before[lo] for lo, _ in blocks(self.before, 1 << 16)], np.int64), [len(x[0]) for x in found])
        self.first, self.windows, self.minimiser, self.key, self.content = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = self.first + base
        self.end = self.first + self.windows - 1 + width
        self.id = self.ids.fill_null(0).to_numpy()[self.doc[self.first]] if len(self.first) else np.zeros(0, np.int64)


def blocks(at: np.ndarray, most: int):
    """(lo, hi) of consecutive texts of about `most` elements; 64-bit arrays over them stay that small (or as one text)."""
    lo, n = 0, len(at) - 1
    while lo < n or lo == n == 0:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1) if n else 0
        yield lo, hi
        lo = hi if n else 1


def alike(raw: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Pieces a and b, of equal content hashes, must have equal bytes."""
    other = np.flatnonzero(a != b)
    a, b = a[other], b[other]
    for lo, hi in blocks(np.append(0, np.cumsum(size[a], dtype=np.int64)), 1 << 18):
        x, y = a[lo:hi], b[lo:hi]
        if (size[x] != size[y]).any() or (raw[gather(first[x], size[x])] != raw[gather(first[y], size[y])]).any():
            raise ValueError("different pieces have one content hash")


def _pieces(values: np.ndarray, at: np.ndarray, counts: np.ndarray, width: int, frequent: tuple[np.ndarray, np.ndarray] | None):
    """(first word, windows, minimiser's hash, hash that deals it, content hash) of the super-k-mers of some texts, from the hashes of their words."""
    roll = Rolling(values)
    long = np.flatnonzero(counts >= width)
    n = counts[long] - width + 1
    places = gather(at[:-1][long], n)
    hashes = roll.each(MINIMISER)
    centre = minimisers(hashes, places, width - MINIMISER + 1)
    first, last, centre = runs(places, centre, np.repeat(long, n))
    least = key = hashes[centre]
    if frequent and len(frequent[0]):
        first, last, centre, key = cut(roll, first, last, centre, least, frequent, MINIMISER, width)
        least = hashes[centre]
    return first, last - first + 1, least, key, roll.of(first, last + width)


def remove_repeats(docs: DataFrame, width: int = 13, chunk_bytes: int = MB * 3 // 2, bucket_bytes: int = MB * 3 // 4, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """SCHEMA for each row; with_text adds the kept words as `text`."""
    routing = Routing(docs, chunk_bytes, bucket_bytes, id_column, text_column)
    buckets = routing.buckets

    def pieces(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not group.num_rows:
            return table([], [], [])
        known, frequent = repeated_and_frequent(answers, width - MINIMISER + 1, hot, PARTS)
        c = _Chunk(group, width, frequent)
        number = group["chunk"][0].as_py()
        some = np.flatnonzero(np.isin(c.minimiser, known))
        order = some[np.lexsort((c.id[some], c.content[some]))]
        content = c.content[order]
        new = np.ones(len(order), bool)
        new[1:] = content[1:] != content[:-1]
        begin = np.flatnonzero(new)
        one = order[begin]
        alike(c.raw, c.start[c.first], c.start[c.end] - c.start[c.first], order[~new], one[np.cumsum(new) - 1][~new])
        low, high = c.id[one], c.id[order[np.append(begin[1:], len(order)) - 1]]
        to = bucket_of(c.key[one], buckets)
        by = np.argsort(to, kind="stable")
        # a note to the chunk itself: which of its minimisers are frequent
        out = ([-1 - number], [number], [pack(*frequent)]) if len(frequent[0]) else ([], [], [])
        for lo, hi in _groups(to[by]):
            some = by[lo:hi]
            p = one[some]
            size = c.start[c.end[p]] - c.start[c.first[p]]
            body = pack(c.raw[gather(c.start[c.first[p]], size)], (c.end[p] - c.first[p]).astype("<i4"), low[some].astype("<i8"), (high - low)[some].astype("<i8"))
            out[0].append(int(to[some[0]])), out[1].append(number), out[2].append(body)
        return table(*out)

    def answer(group: pa.Table) -> pa.Table:
        if group["bucket"][0].as_py() < 0:
            return group
        chunks = group["chunk"].to_pylist()
        parts = [unpack(x.as_py()) for x in group["body"]]
        raw, n_words, low, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        ws, we, _ = words(raw, np.array([0, len(raw)]))
        starts = np.append(0, np.cumsum(n_words))
        exact = strings(raw, ws, len(raw)).dictionary_encode().indices.to_numpy()  # a word and its blank
        windows = n_words - width + 1
        piece, at = spans(windows)
        first = starts[:-1][piece] + at
        order = same_windows(exact, first, width)
        ids = low[piece]
        lead = order[1]
        least = np.minimum.reduceat(ids[order[0]], np.flatnonzero(lead)) if len(first) else ids
        result = np.empty(len(first), np.int64)
        result[order[0]] = least[np.cumsum(lead) - 1]
        before = np.cumsum(windows) - windows
        need = np.minimum.reduceat(result, before) < low + more if len(before) else np.zeros(0, bool)
        content = Rolling(word_hashes(raw, ws, we)).of(starts[:-1], starts[1:])
        out = ([], [], [])
        bucket = group["bucket"][0].as_py()
        p = np.flatnonzero(need)
        for lo, hi in _groups(owner[p]):
            some = p[lo:hi]
            out[0].append(bucket), out[1].append(chunks[owner[some[0]]])
            out[2].append(pack(content[some], windows[some].astype("<i4"), result[gather(before[some], windows[some])]))
        return table(*out)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        bodies = [(b < 0, unpack(x)) for b, x in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True)]
        found, frequent = [x for note, x in bodies if not note], next((tuple(x) for note, x in bodies if note), None)
        c = _Chunk(group, width, frequent)
        gone = np.zeros(c.n, bool)
        if found:
            content, windows, least = (np.concatenate(x) for x in zip(*found, strict=True))
            before = np.cumsum(windows) - windows
            order = np.argsort(content)
            place = np.minimum(np.searchsorted(content[order], c.content), len(order) - 1)
            hit = np.flatnonzero(content[order][place] == c.content)
            answer_of = order[place[hit]]
            run, at = spans(c.windows[hit])
            bad = least[before[answer_of][run] + at] < c.id[hit][run]
            lo = (c.first[hit][run] + at)[bad]
            gone = covered(lo, lo + width, c.n)
        sums = np.append(0, np.cumsum(gone))
        keep = np.repeat(~gone, np.diff(c.start))
        kept = c.raw[keep]
        to = np.append(0, np.cumsum(keep))[c.start][c.before].tolist()
        view = memoryview(kept)
        texts = [view[a : max(a, b - 1)] for a, b in zip(to, to[1:], strict=False)]
        out = {"doc_id": c.ids, "n_words": np.diff(c.before), "n_removed": np.diff(sums[c.before]), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        return pa.table(out | ({"text": pa.array([bytes(t).decode() for t in texts], pa.string())} if with_text else {}))

    known = routing.repeated(lambda group: _Chunk(group, width).key, counted=True)
    return routing.finish(routing.answer(routing.ask_again(known, pieces), answer), finish, SCHEMA + ", text string" * with_text)


def same_windows(ids: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows ids[first : first+width] in which equal ones are neighbours, and where each group begins.

    Windows are sorted by a hash; neighbours of equal hash are compared word by word, and if any differ, all
    are sorted by their words.
    """
    hashes = Rolling(ids.astype(U64) + U64(1)).of(first, first + width)
    order = np.argsort(hashes)
    lead = np.ones(len(order), bool)
    lead[1:] = hashes[order[1:]] != hashes[order[:-1]]
    a, b = first[order[:-1]][~lead[1:]], first[order[1:]][~lead[1:]]
    if any((ids[a + k] != ids[b + k]).any() for k in range(width)):
        order = np.lexsort([ids[first + k] for k in range(width)])
        x, y = first[order[1:]], first[order[:-1]]
        lead[1:] = np.logical_or.reduce([ids[x + k] != ids[y + k] for k in range(width)])
    return order, lead


__all__ = ["alike", "blocks", "remove_repeats", "same_windows"]
