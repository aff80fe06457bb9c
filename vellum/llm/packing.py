"""Operator 1: cost-balanced packing of documents into token sequences.

Each document's cost is estimated as linear * tokens + quadratic * tokens**2 (the latter for attention).  Within a
group of documents of bounded size, pieces go by descending length to the sequence of lowest cost that has
room; a piece for which none has room is cut at the largest room.  A group opens only as many sequences as its tokens
fill, so that less than one sequence of padding is lost in a group.

Null texts count as empty; each row, repeated or not, is packed as a document of its own; a null doc_id stays null; an
empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vellum.llm.encoders import encoder, with_end
from vellum.llm.flat import slices
from vellum.llm.shared import MB, partitions, pieces_for, settled

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths."""
    out, sequences, items = [], 0, []
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity:  # a full sequence of its own
            out.append((doc, start, capacity, sequences, 0))
            sequences += 1
            start += capacity
        if n > start:
            items.append((start - n, doc, start))
    heapq.heapify(items)
    count = -(-sum(-x[0] for x in items) // capacity)
    room = [capacity] * count
    cost = [0.0] * count
    fitting = [(0.0, s) for s in range(count)]  # those with room for the current length, by cost
    tight: list[tuple[int, int]] = []  # the others, by room
    while items:
        size, doc, start = heapq.heappop(items)
        size = -size
        while tight and -tight[0][0] >= size:
            s = heapq.heappop(tight)[1]
            heapq.heappush(fitting, (cost[s], s))
        s = -1
        while fitting:
            _, s = heapq.heappop(fitting)
            if room[s] >= size:
                break
            heapq.heappush(tight, (-room[s], s))
            s = -1
        take = size
        if s < 0:
            take, s = heapq.heappop(tight)
            take = -take
            heapq.heappush(items, (take - size, doc, start + take))
        out.append((doc, start, take, sequences + s, capacity - room[s]))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if room[s]:
            heapq.heappush(fitting, (cost[s], s))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_tokens: int = 4_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece (SCHEMA).  Documents are grouped as they lie, so that no text is exchanged."""

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        ids_of, sizes, names, tokens = [], [], [], 0

        def flush():
            nonlocal made, tokens
            length = np.concatenate(sizes)
            ids, at = np.concatenate(ids_of), np.append(0, np.cumsum(length))
            doc, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*assign(length, capacity), strict=True))
            lo = at[doc] + start
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(lo.tolist(), size.tolist(), strict=True)]
            name = pa.concat_arrays(names).take(pa.array(doc))
            out = pa.RecordBatch.from_arrays([name, *map(pa.array, (start, size, np.array(crc, np.int64), length[doc], first + made + seq, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            made += int(seq.max()) + 1
            for x in (ids_of, sizes, names):
                x.clear()
            tokens = 0
            return out

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, at = with_end(*encoder(tokenizer).encode(part.column("text")), end_id)
                ids_of.append(ids.astype("<u4"))
                sizes.append(np.diff(at))
                names.append(part.column("doc_id"))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield flush()
        if sizes and tokens:
            yield flush()

    docs = settled(docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"`{text_column}` text"))
    return docs.coalesce(max(pieces_for(docs, 4 * MB), partitions(docs.sparkSession))).mapInArrow(run, SCHEMA)
