"""Questions from chunks of documents to buckets of content, and the answers back.

Documents are dealt into chunks of a few MB.  A chunk packs all it asks of a bucket into one compressed row;
content that it holds many times it asks for once, so that a passage in very many documents makes at most one row a
chunk.  A bucket answers each chunk in one row.  Both passes over the chunks use the same exchange of the texts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.flat import BASE, U64, Rolling, mix, sliding_min, spans
from vellum.llm.shared import pieces_for, settled, spread

ROW = "bucket int, chunk int, body binary"
KINDS = ["<u1", "<i4", "<i8", "<u8", "<u2"]


def pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        kind = next(i for i, k in enumerate(KINDS) if a.dtype == np.dtype(k))
        parts += [struct.pack("<BQ", kind, len(a)), np.ascontiguousarray(a).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<BQ", data, at)
        out.append(np.frombuffer(data, KINDS[kind], n, at + 9))
        at += 9 + out[-1].nbytes
    return out


def table(buckets: list[int], chunks: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(chunks, pa.int32()), "body": pa.array(bodies, pa.binary())})


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Minimisers are the small ones among hashes, so they are mixed again before they are dealt out."""
    return ((mix(hashes ^ U64(BASE)) >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


def groups(keys: np.ndarray):
    """(lo, hi) of the runs of equal keys."""
    if len(keys):
        cut = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        yield from zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True)


def _often(group: pa.Table) -> pa.Table:
    """A bucket's answer: the keys that occur twice or more, and how often, to each chunk that has them."""
    chunks = group["chunk"].to_pylist()
    parts = [unpack(x.as_py()) for x in group["body"]]
    keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    values, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, weights=times, minlength=len(values))
    often = total >= 2
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    p = np.flatnonzero(often[which])
    out = ([], [], [])
    for lo, hi in groups(owner[p]):
        out[0].append(group["bucket"][0].as_py()), out[1].append(chunks[owner[p[lo]]]), out[2].append(pack(keys[p[lo:hi]], total[which[p[lo:hi]]].astype("<i8")) if times.dtype != np.uint8 else pack(keys[p[lo:hi]]))
    return table(*out)


class Routing:
    def __init__(self, docs: DataFrame, chunk_bytes: int, bucket_bytes: int, id_column: str = "doc_id", text_column: str = "text", carry: bool = False):
        """carry: chunks also hold each row's other columns, in `rest`."""
        docs = settled(docs)
        self.partitions = spread(docs)
        n = pieces_for(docs, chunk_bytes)
        self.buckets = pieces_for(docs, bucket_bytes)
        rest = [c for c in docs.columns if c != text_column]
        mark = "_" * (1 + max(map(len, docs.columns)))  # so that the struct has a field
        others = [F.struct(F.lit(True).alias(mark), *(F.col(f"`{c}`") for c in rest)).alias("rest")] if carry else []
        rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), *others)
        self.docs = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(self.partitions, "chunk")

    def ask(self, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """f: a chunk -> its questions, a row (ROW) for each bucket."""
        return self.docs.groupBy("chunk").applyInArrow(f, ROW)

    def ask_again(self, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """f: a chunk and the answers to it -> more questions."""
        return self.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, ROW)

    def answer(self, questions: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """f: all questions to a bucket -> its answers, a row for each chunk."""
        return questions.repartition(self.partitions, "bucket").groupBy("bucket").applyInArrow(f, ROW)

    def repeated(self, keys_of: Callable[[pa.Table], np.ndarray], counted: bool = False) -> DataFrame:
        """keys_of: the keys of a chunk's pieces.  Answers to each chunk: those of its keys that occur twice or more in all chunks; counted: with how often."""
        buckets = self.buckets

        def ask(group: pa.Table) -> pa.Table:
            keys, count = np.unique(keys_of(group), return_counts=True)
            to = bucket_of(keys, buckets)
            by = np.argsort(to, kind="stable")
            to, keys, times = to[by], keys[by], (count.astype("<i4") if counted else np.minimum(count, 2).astype(np.uint8))[by]
            number, out = group["chunk"][0].as_py(), ([], [], [])
            for lo, hi in groups(to):
                out[0].append(int(to[lo])), out[1].append(number), out[2].append(pack(keys[lo:hi], times[lo:hi]))
            return table(*out)

        return self.answer(self.ask(ask), _often)

    def finish(self, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f: a chunk and the answers to it -> results."""
        return self.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)


def ordered(group: pa.Table) -> pa.Table:
    """A chunk in the same order each time."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def minimisers(hashes: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """For windows that start at these places: the place of the smallest hash (leftmost on ties) among width places."""
    bits = U64(28)
    if len(hashes) >> 28:
        raise ValueError("a text of 2**28 places or more")
    packed = hashes >> bits
    packed <<= bits
    packed |= np.arange(len(hashes), dtype=U64)
    return (sliding_min(packed, width)[places] & (U64(1) << bits) - U64(1)).astype(np.int64)


def runs(places: np.ndarray, centre: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of one document with one minimiser: first and last window of each, and the minimiser."""
    if not len(places):
        return places, places, centre
    new = np.ones(len(places), bool)
    new[1:] = (centre[1:] != centre[:-1]) | (places[1:] != places[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return places[begin], places[np.append(begin[1:], len(places)) - 1], centre[begin]


def parts_of(times: np.ndarray, span: int, hot: int, parts: Sequence[int]) -> np.ndarray:
    """Into how many parts pieces are cut whose minimiser, with `span` places in a window, occurs so many times: the first of `parts` beyond hot, the next beyond 4 times that, and so on."""
    limits = [hot * 4**k for k in range(len(parts))]
    return np.minimum(np.array([1, *parts]), span)[np.searchsorted(limits, times)].astype(np.uint8)


def repeated_and_frequent(answers: pa.Table, span: int, hot: int, parts: Sequence[int]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """From a chunk's answers by Routing.repeated(counted=True): its repeated keys, ascending, and those whose pieces are cut, with the number of parts."""
    known, times = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in answers["body"]), strict=True))
    order = np.argsort(known)
    known, n = known[order], parts_of(times[order], span, hot, parts)
    return known, (known[n > 1], n[n > 1])


def cut(roll: Rolling, first: np.ndarray, last: np.ndarray, centre: np.ndarray, key: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], anchor: int, width: int):
    """Pieces (first and last window, minimiser, its hash) with those of frequent minimisers cut: first and last window, minimiser, and the hash that deals each.

    Pieces are cut where the minimiser's place in the window passes from one of equal parts to another.  With the minimiser at the places low to high,
    all windows of a part hold the `low` elements before it, and width-anchor-high after it, by which the part is dealt: equal windows have equal places, and so one hash.
    """
    span = width - anchor + 1
    place = np.minimum(np.searchsorted(frequent[0], key), len(frequent[0]) - 1)
    parts = np.where(frequent[0][place] == key, frequent[1][place], 1).astype(np.int64)
    hot, cold = np.flatnonzero(parts > 1), np.flatnonzero(parts == 1)
    piece, at = spans(last[hot] - first[hot] + 1)
    window, middle, n = first[hot][piece] + at, centre[hot][piece], parts[hot][piece]
    part = (middle - window) * n // span
    head = np.flatnonzero((np.diff(piece, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    tail = np.append(head[1:], len(window))[: len(head)] - 1
    j, n, middle = part[head], n[head], middle[head]
    low, high = -(-j * span // n), -(-(j + 1) * span // n) - 1
    around = mix(roll.of(middle - low, middle + width - high) + (j + 1).astype(U64) * U64(BASE))
    return tuple(np.concatenate(x) for x in ((first[cold], window[head]), (last[cold], window[tail]), (centre[cold], middle), (key[cold], around)))
