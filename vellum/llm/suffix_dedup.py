"""Operator 5: removal of repeated byte strings with a Burrows-Wheeler transform and bounded interval expansion.

Candidates first: each window of `length` bytes has a minimiser, the 32 bytes of smallest hash in it.  Chunks ask which
minimisers occur more than once in the corpus, and send only the pieces (consecutive windows with one such minimiser) to its
bucket, equal pieces of a chunk once.  A bucket builds the transform of its distinct pieces, each with its multiplicity (all copies
are compared byte by byte with the first), expands intervals breadth-first by backward extension, which yields the common
prefixes of neighbouring suffixes by increasing value, and stops at `length`: boundaries without a value by then join
suffixes that share `length` bytes, and an interval whose suffixes count twice or more, by their multiplicities, is repeated.
Where the pieces of one minimiser are too many for one transform, those of their windows whose hash no other has are left out before it; what is
left, equal stretches once, is decided by the transform as all else.  The pieces of a minimiser that occurs very often are cut before they travel, by where it
lies in their windows, and dealt by the bytes that the windows of a part share around it, so that they go to many buckets.

Null and empty texts have no bytes; texts shorter than `length` lose none (a text of 2**28 bytes or more is an error); rows with equal doc_ids are documents of
their own, so repeated rows remove each other; a null doc_id is a document like others; an empty table gives no rows.
A cut may fall inside a character: kept bytes are defined, and `text` (with_text) drops the rests of such characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.flat import SPREAD, U64, Rolling, covered, flat, gather, spans
from vellum.llm.routing import Routing, bucket_of, cut, minimisers, ordered, pack, repeated_and_frequent, runs, table, unpack
from vellum.llm.routing import groups as _groups
from vellum.llm.shared import MB
from vellum.llm.substring_dedup import alike, blocks

ANCHOR = 32
#: Times that a minimiser may occur before its pieces are cut, and the parts they are cut into first (routing.parts_of).
HOT, PARTS = 1 << 14, (2, 8, 32)
#: Bytes of pieces with one minimiser from which unique windows are left out before the transform.
LARGE = MB
#: Windows whose hashes are sorted together.
SORTED = 1 << 21
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Chunk:
    """A chunk's pieces: consecutive windows of a document that share a minimiser; `frequent` are minimisers, ascending, and the parts into which theirs are cut."""

    def __init__(self, group: pa.Table, length: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        group = ordered(group)
        self.raw, self.at = flat(group["text"])
        found = [_pieces(self.raw[self.at[lo] : self.at[hi]], self.at[lo : hi + 1] - self.at[lo], length, frequent) for lo, hi in blocks(self.at, 1 << 18)]
        base = np.repeat(np.array([self.at[lo] for lo, _ in blocks(self.at, 1 << 18)], np.int64), [len(x[0]) for x in found])
        self.first, self.windows, self.minimiser, self.key, self.place, self.content = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = self.first + base
        self.end = self.first + self.windows - 1 + length


def _pieces(raw: np.ndarray, at: np.ndarray, length: int, frequent: tuple[np.ndarray, np.ndarray] | None):
    """(first byte, windows, minimiser's hash, hash that deals the piece, the minimiser's place in the piece, content hash) of the pieces of some texts."""
    size = np.diff(at)
    roll = Rolling(SPREAD[raw])
    hashes = roll.each(ANCHOR)
    long = np.flatnonzero(size >= length)
    counts = size[long] - length + 1
    places = gather(at[:-1][long], counts)
    centre = minimisers(hashes, places, length - ANCHOR + 1)
    first, last, centre = runs(places, centre, np.repeat(long, counts))
    key = hashes[centre]
    if frequent and len(frequent[0]):
        first, last, centre, key = cut(roll, first, last, centre, key, frequent, ANCHOR, length)
    return first, last - first + 1, hashes[centre], key, (centre - first).astype("<u2"), roll.of(first, last + length)


def remove_repeats(docs: DataFrame, length: int = 200, chunk_bytes: int = MB, bucket_bytes: int = MB, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, large: int = LARGE, hot: int = HOT) -> DataFrame:
    """SCHEMA for each row; with_text adds the kept text as `text` and the row's other columns as `rest`."""
    routing = Routing(docs, chunk_bytes, bucket_bytes, id_column, text_column, with_text)
    buckets = routing.buckets

    def pieces(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not group.num_rows:
            return table([], [], [])
        known, frequent = repeated_and_frequent(answers, length - ANCHOR + 1, hot, PARTS)
        c = _Chunk(group, length, frequent)
        number = group["chunk"][0].as_py()
        some = np.flatnonzero(np.isin(c.minimiser, known))
        some = some[np.argsort(c.first[some], kind="stable")]
        _, index, which, times = np.unique(c.content[some], return_index=True, return_inverse=True, return_counts=True)
        times = np.minimum(times, 2).astype(np.uint8)
        one = some[index]
        alike(c.raw, c.first, c.end - c.first, some, one[which])
        to = bucket_of(c.key[one], buckets)
        by = np.argsort(to, kind="stable")
        ordinal = np.empty(len(by), "<i4")
        ordinal[by] = np.arange(len(by))
        # a note to the chunk itself: where its pieces begin, and which of the distinct ones they are
        out = ([-1 - number], [number], [pack(np.diff(c.first[some], prepend=0).astype("<i4"), ordinal[which])])
        for lo, hi in _groups(to[by]):
            p = one[by[lo:hi]]
            size = c.end[p] - c.first[p]
            body = pack(c.raw[gather(c.first[p], size)], size.astype("<i4"), times[by[lo:hi]], c.place[p], np.array([lo], "<i4"))
            out[0].append(int(to[by[lo]])), out[1].append(number), out[2].append(body)
        return table(*out)

    def answer(group: pa.Table) -> pa.Table:
        if group["bucket"][0].as_py() < 0:
            return group
        chunks = group["chunk"].to_pylist()
        parts = [unpack(x.as_py()) for x in group["body"]]
        raw, size, times, place, number = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin = np.cumsum([0] + [len(p[1]) for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        lo = np.cumsum(size) - size
        one, which, times, key = _same_pieces(raw, lo, size, times, place)
        # a piece that occurs once and whose minimiser no other has shares no window
        _, group_of, members = np.unique(key, return_inverse=True, return_counts=True)
        given = np.flatnonzero((members[group_of] > 1) | (times > 1))
        # pieces with a common minimiser go together, some 64 KB at a time
        given = given[np.argsort(group_of[given], kind="stable")]
        n = size[one[given]].astype(np.int64)
        text_at = np.zeros(len(one), np.int64)
        text_at[given] = np.cumsum(n) - n
        flags = np.zeros(int(n.sum()), bool)
        for a, b in _batches(group_of[given], n):
            some = one[given[a:b]]
            to = int(text_at[given[a]])
            total = int(n[a:b].sum())
            decide = thinned if total > large else repeated
            flags[to : to + total] = decide(raw[gather(lo[some], size[some])], size[some], length, times[given[a:b]])
        windows = size[one].astype(np.int64) - length + 1
        p = np.sort(given)
        run, at = spans(windows[p])
        on = flags[text_at[p][run] + at]
        head = np.flatnonzero(on & ((at == 0) | ~np.append(False, on)[:-1]))
        tail = np.flatnonzero(on & ((at == windows[p][run] - 1) | ~np.append(on, False)[1:]))
        start, end, of_ = at[head], at[tail] + 1, p[run[head]]
        count = np.bincount(of_, minlength=len(one))
        before = np.cumsum(count) - count
        need = np.flatnonzero(count[which] > 0)
        out = ([], [], [])
        for a, b in _groups(owner[need]):
            w, whose = which[need[a:b]], owner[need[a]]
            index = gather(before[w], count[w])
            out[0].append(group["bucket"][0].as_py()), out[1].append(chunks[whose])
            out[2].append(pack((need[a:b] - begin[whose] + number[whose]).astype("<i4"), count[w].astype("<i4"), start[index].astype("<i4"), end[index].astype("<i4")))
        return table(*out)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = ordered(group)
        ids, (raw, at) = group["doc_id"].combine_chunks(), flat(group["text"])
        gone = np.zeros(len(raw), bool)
        parts = [(b.as_py(), unpack(x.as_py())) for b, x in zip(answers["bucket"], answers["body"], strict=True)]
        told = [x for b, x in parts if b >= 0]
        if told:
            steps, which = next(x for b, x in parts if b < 0)
            piece, count, start, end = (np.concatenate(x) for x in zip(*told, strict=True))
            many, before = np.zeros((2, int(which.max()) + 1), np.int64)
            many[piece], before[piece] = count, np.cumsum(count) - count
            hit = np.flatnonzero(many[which])
            found = which[hit]
            index = gather(before[found], many[found])
            base = np.repeat(np.cumsum(steps, dtype=np.int64)[hit], many[found])
            gone = covered(base + start[index], base + end[index] - 1 + length, len(raw))
        sums = np.append(0, np.cumsum(gone))
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inside = at[:-1][at[:-1] < len(raw)]
        head[inside] = gone[inside]
        heads = np.append(0, np.cumsum(head))
        kept = raw[~gone]
        to = (at - sums[at]).tolist()
        view = memoryview(kept)
        texts = [view[a:b] for a, b in zip(to, to[1:], strict=False)]
        out = {"doc_id": ids, "n_bytes": np.diff(at), "n_removed": np.diff(sums[at]), "n_spans": np.diff(heads[at]), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        return pa.table(out | ({"text": pa.array([bytes(t).decode(errors="ignore") for t in texts], pa.string()), "rest": group["rest"]} if with_text else {}))

    known = routing.repeated(lambda group: _Chunk(group, length).key, counted=True)
    asked = routing.ask_again(known, pieces)
    return routing.finish(routing.answer(asked, answer), finish, _schema(routing.docs) if with_text else SCHEMA)


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(SCHEMA).fields, T.StructField("text", T.StringType()), docs.schema["rest"]])


def clean(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the same columns and rows, without the repeated bytes; a column n_chars is counted anew."""
    out = remove_repeats(docs, length, id_column=id_column, text_column=text_column, with_text=True)
    new = {text_column: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def _same_pieces(raw, lo, size, times, place):
    """Equal pieces once: one index of each, which of them each piece is, their multiplicities, their minimisers' hashes."""
    hashes, keys = np.empty(len(size), U64), np.empty(len(size), U64)
    for a, b in blocks(np.append(lo, len(raw)), 1 << 18):
        if a < b:
            roll = Rolling(SPREAD[raw[lo[a] : lo[b - 1] + size[b - 1]]])
            at = lo[a:b] - lo[a]
            hashes[a:b], anchor = roll.of(at, at + size[a:b]), at + place[a:b]
            keys[a:b] = roll.of(anchor, anchor + ANCHOR)
    content, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    alike(raw, lo, size, np.arange(len(size)), one[which])
    return one, which, np.bincount(which, weights=times, minlength=len(content)), keys[one]


def _batches(groups: np.ndarray, sizes: np.ndarray, most: int = 1 << 16):
    """(lo, hi) of whole groups of about `most` bytes, whose arrays stay in a core's cache; groups are sorted."""
    cut = np.append(np.flatnonzero(np.diff(groups)) + 1, len(groups))
    total = np.append(0, np.cumsum(sizes))
    lo = 0
    while lo < len(groups):
        fits = cut[(cut > lo) & (total[cut] <= total[lo] + most)]
        hi = int(fits[-1]) if len(fits) else int(cut[np.searchsorted(cut, lo, "right")])
        yield lo, hi
        lo = hi


def suffix_array(text: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Order by their first `depth` symbols of all suffixes of pieces with these sizes, each piece followed by its own end mark (marks: -1 in text, by piece).

    Suffixes are sorted by as many symbols as fit into 64 bits, and those that are still equal by the ranks of their next stretches: three
    at a time where their ranks fit, else two.
    """
    n = len(text)
    piece, at = spans(size + 1)
    left = (size + 1)[piece] - at  # symbols to the piece's end mark, with it
    codes = np.zeros(257, U64)
    codes[1:] = np.cumsum(np.bincount(text + 1, minlength=257)[1:] > 0)
    bits = int(codes[-1]).bit_length()
    h = 64 // bits
    sym = codes[text + 1]
    key, have = sym, 1
    while have < h:  # by doubling
        step = min(have, h - have)
        more = np.zeros(n, U64)
        more[:-have] = key[have:] >> U64(bits * (have - step))
        more[left <= have] = 0
        key = key << U64(bits * step) | more
        have += step
    order = np.argsort(key)
    lead = np.ones(n, bool)
    lead[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    width = (n + len(size)).bit_length()
    ways = 3 if 3 * width <= 64 else 2
    while True:
        some = np.flatnonzero(~(lead & np.append(lead[1:], True)))
        if not len(some) or h >= depth:
            return order
        who = order[some]
        key = rank[who]
        for k in range(1, ways):
            # past an end mark the piece's number decides
            key = key << width | np.where(left[who] <= k * h, piece[who], len(size) + rank[np.minimum(who + k * h, n - 1)])
        by = np.argsort(key.view(U64))
        who, key = who[by], key[by]
        order[some] = who
        new = np.ones(len(some), bool)
        new[1:] = key[1:] != key[:-1]
        lead[some] = new
        rank[who] = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        h *= ways


def repeated(raw: np.ndarray, size: np.ndarray, length: int, times: np.ndarray) -> np.ndarray:
    """For each byte of pieces of these sizes (in one array), which occur so many times: does the string of `length` bytes from it also start elsewhere?

    Breadth-first expansion over intervals of the transform: a child of the interval of w is that of cw; the
    first interval to end at a boundary gives the boundary's common prefix, the length of w.  An interval's children are
    found from the transform's runs in it: the last place of a byte in an interval ends a run or the interval.
    """
    size = size.astype(np.int64)
    n = len(raw) + len(size)
    text = np.full(n, -1, np.int16)
    piece, at = spans(size)
    where = np.arange(len(raw)) + piece
    text[where] = raw
    order = suffix_array(text, size, length)
    before = text[order - 1]  # the transform; order 0 looks at the last end mark
    rows = np.arange(n)
    by = np.argsort(before, kind="stable")
    marks = len(size)
    to = np.empty(n, np.int64)  # last-to-first mapping, sound for bytes
    to[by] = rows
    byte = before >= 0
    follows = np.full(n, n, np.int64)  # next row with the same byte
    same = before[by[1:]] == before[by[:-1]]
    follows[by[:-1][same]] = by[1:][same]
    keys = before[by].astype(np.int64) * (n + 1) + by
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    # depth 1: the interval of each byte, and of each end mark
    count = np.bincount(text[order].astype(np.int64) + 1, minlength=257)[1:]
    hi = np.append(np.arange(1, marks + 1), marks + np.cumsum(count)[count > 0])
    lo = np.append(np.arange(marks), (marks + np.cumsum(count) - count)[count > 0])
    known[hi] = True
    ends = np.append(np.flatnonzero(before[1:] != before[:-1]), n - 1)  # of the transform's runs
    run_of = np.searchsorted(ends, rows)
    for _ in range(1, length):
        if not len(lo):
            break
        run, k = spans(run_of[hi - 1] - run_of[lo] + 1)
        row = np.minimum(ends[run_of[lo][run] + k], hi[run] - 1)
        last = byte[row] & (follows[row] >= hi[run])
        row, run = row[last], run[last]
        end = to[row] + 1
        fresh = ~known[end]
        row, run, end = row[fresh], run[fresh], end[fresh]
        known[end] = True
        first = lo[run]
        begin = to[first]
        other = np.flatnonzero(before[first] != before[row])  # where the interval does not begin with the byte
        begin[other] = np.searchsorted(keys, before[row[other]].astype(np.int64) * (n + 1) + first[other])
        lo, hi = begin, end
    # the intervals that are left, and how often their strings occur
    interval = np.cumsum(known[:n]) - 1
    count = np.zeros(n)
    count[where] = times[piece]
    total = np.bincount(interval, weights=count[order])
    flag = np.zeros(n, bool)
    flag[order] = total[interval] >= 2
    return flag[where] & (at + length <= size[piece])


def thinned(raw: np.ndarray, size: np.ndarray, length: int, times: np.ndarray) -> np.ndarray:
    """repeated() for many pieces, by transforms of those of their windows that may be repeated: the others' hashes occur once.

    Pieces are cut where the number of times changes that a window's hash occurs.  Equal windows have equal numbers, so stretches of different
    numbers go to different transforms, and so may single windows, as each stands there once: equal stretches enter once, with
    the sum of their multiplicities.  Hashes are sorted a part at a time.
    """
    size = size.astype(np.int64)
    lo = np.cumsum(size) - size
    windows = size - length + 1
    hashes = np.empty(int(windows.sum()), U64)
    at = np.cumsum(windows) - windows
    for a, b in blocks(np.append(lo, len(raw)), 1 << 18):
        if a < b:
            each = Rolling(SPREAD[raw[lo[a] : lo[b - 1] + size[b - 1]]]).each(length)
            hashes[at[a] : at[b - 1] + windows[b - 1]] = each[gather(lo[a:b] - lo[a], windows[a:b])]
    owner = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    count = np.zeros(len(hashes), np.int32)
    parts = -(-len(hashes) // SORTED)
    for part in range(parts):
        some = np.flatnonzero(hashes % U64(parts) == U64(part))
        some = some[np.argsort(hashes[some])]
        first = np.flatnonzero(np.append(True, hashes[some[1:]] != hashes[some[:-1]])) if len(some) else some
        if len(some):
            total = np.minimum(np.add.reduceat(times[owner[some]].astype(np.int64), first), 1 << 30)
            count[some] = np.repeat(total, np.diff(np.append(first, len(some))))
    flags = np.zeros(len(raw), bool)
    edge = (np.diff(owner) != 0) | (np.diff(count) != 0)
    head = np.flatnonzero((count > 1) & np.append(True, edge))
    tail = np.flatnonzero((count > 1) & np.append(edge, True))
    if not len(head):
        return flags
    begin = lo[owner[head]] + head - at[owner[head]]
    left = tail - head + length
    content = np.empty(len(head), U64)
    for a in range(0, len(head), 1024):
        b = min(a + 1024, len(head))
        to = np.cumsum(left[a:b])
        content[a:b] = Rolling(SPREAD[raw[gather(begin[a:b], left[a:b])]]).of(to - left[a:b], to)
    _, one, which = np.unique(content, return_index=True, return_inverse=True)
    alike(raw, begin, left, np.arange(len(head)), one[which])
    weight = np.bincount(which, weights=times[owner[head]], minlength=len(one))
    number = count[head[one]].astype(np.int64)
    order = np.argsort(number, kind="stable")
    longest = np.zeros(len(one), np.int64)
    first = np.flatnonzero(np.diff(number[order], prepend=-1))
    longest[order] = np.repeat(np.maximum.reduceat(left[one[order]], first), np.diff(np.append(first, len(order))))
    apart = np.where(longest[order] == length, np.arange(len(order)), 0)
    group = np.cumsum((np.diff(number[order], prepend=-1) != 0) | (apart > 0))
    kept = np.empty(len(one), object)
    for a, b in _batches(group, left[one[order]]):
        some = order[a:b]
        n = left[one[some]]
        for k, part in zip(some.tolist(), np.split(repeated(raw[gather(begin[one[some]], n)], n, length, weight[some]), np.cumsum(n)[:-1]), strict=True):
            kept[k] = part
    found = np.concatenate(kept)
    from_ = np.cumsum(left[one]) - left[one]
    flags[gather(begin, left)] |= found[gather(from_[which], left)]
    return flags


__all__ = ["remove_repeats", "repeated", "suffix_array", "thinned"]
