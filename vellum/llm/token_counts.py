"""Operator 12: token counts of whole texts; huge documents are counted in overlapping chunks that are spliced again.

Texts up to a chunk and its overlap are counted where they lie.  A longer one is cut into chunks of `chunk` bytes that each reach
`overlap` bytes into the next, spread over all tasks, and encoded with offsets.  Two neighbours are spliced at a stable common
boundary: a place in their overlap at which a unit begins in both encodings.  It is proven so: the words of a byte-level tokenizer
are found from left to right by a pattern that looks back at nothing and ahead by a few characters, so that all that follows a
place where a word begins depends only on the text from there; the left chunk sees the place as the whole text does, since it
has MARGIN bytes more than the pattern and the longest special token look ahead.  Between two such places a chunk has the
whole text's ids.  Documents with a pair of neighbours that share no such place (an unbroken run longer than the overlap) are
encoded again with chunks and overlaps WIDER times as large, until all splice or one chunk holds the text.

Null texts count as empty.  Rows alike in id and text are encoded each and spliced once; every one of them gets its row.  Null ids, ties and
further columns, whatever their names, change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.encoders import VocabularyEncoder, encoder
from vellum.llm.flat import slices, strings
from vellum.llm.shared import written

#: Bytes of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 32 << 10, 1 << 10
#: Growth of both where chunks do not splice.
WIDER = 4
#: Bytes that decide a word's end: the longest contraction, one character of look-ahead, and room.
AHEAD = 16


def byte_level(path: str) -> VocabularyEncoder:
    """The encoder of a byte-level file; other kinds rewrite or drop characters, so that their words have no places in the text."""
    found = encoder(path)
    if not isinstance(found, VocabularyEncoder) or found.strip:
        raise ValueError("chunks are counted for byte-level tokenizers only")
    return found


def units(enc: VocabularyEncoder, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where the units of all texts begin, the tokens before each (and in all), and where the texts begin and end, in bytes."""
    raw, offsets = enc.prepare(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), offsets
    first, _ = enc.cuts(raw, offsets)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first)
    found = strings(raw, starts, len(raw)).dictionary_encode()
    _, sizes = enc.distinct(found.dictionary)
    return starts, np.append(0, np.cumsum(sizes[found.indices.to_numpy()])), offsets


def _whole_characters(body: bytes) -> tuple[int, int]:
    """The part of a slice of UTF-8 that consists of whole characters."""
    lo, hi = 0, len(body)
    while lo < hi and body[lo] & 0xC0 == 0x80:
        lo += 1
    last = hi - 1
    while last >= lo and body[last] & 0xC0 == 0x80:
        last -= 1
    if last >= lo and body[last] >= 0xC0 and hi - last < 2 + (body[last] >= 0xE0) + (body[last] >= 0xF0):
        hi = last
    return lo, hi


def _counter(path: str):
    def run(batches):
        enc = byte_level(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                starts, before, offsets = units(enc, part.column("text"))
                n = np.diff(before[np.searchsorted(starts, offsets)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


#: An edge lies between a chunk and the next.  `at` are places in the whole text where units begin, `before` the chunk's tokens before them.
EDGE = "doc_id long, ha long, hb long, n_bytes long, edge long, ends boolean, left boolean, at array<long>, before array<long>"


def _edges(path: str, overlap: int):
    """Of each chunk: what it sees of the edge before it and of the edge behind it; behind the last chunk, all its tokens."""

    def run(batches):
        enc = byte_level(path)
        margin = AHEAD + max(map(len, enc.marks), default=0)
        for batch in batches:
            for part in slices(batch, "body", 4 << 20):
                rows = part.to_pylist()
                cut = [_whole_characters(r["body"]) for r in rows]
                starts, before, offsets = units(enc, pa.array([r["body"][a:b] for r, (a, b) in zip(rows, cut, strict=True)], pa.binary()))
                lo = np.searchsorted(starts, offsets)
                out = []
                for k, r in enumerate(rows):
                    mine = slice(lo[k], lo[k + 1])
                    at, n = starts[mine] - offsets[k] + cut[k][0] + r["from"], before[mine] - before[lo[k]]
                    same = {c: r[c] for c in ("doc_id", "ha", "hb", "n_bytes")}
                    if r["from"]:
                        near = at <= r["from"] + overlap
                        out.append(same | {"edge": r["k"] - 1, "ends": False, "left": False, "at": at[near], "before": n[near]})
                    if r["ends"]:
                        out.append(same | {"edge": r["k"], "ends": True, "left": True, "at": [], "before": [int(before[lo[k + 1]] - before[lo[k]])]})
                    else:
                        near = (at >= r["upto"] - overlap) & (at <= r["upto"] - margin)
                        out.append(same | {"edge": r["k"], "ends": False, "left": True, "at": at[near], "before": n[near]})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "ha", "hb", "n_bytes", "edge")), ("ends", pa.bool_()), ("left", pa.bool_()), ("at", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])
    return run


def _spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ha, hb, n_bytes, n_tokens, copies) of long texts; n_tokens is null where two chunks share no stable boundary."""
    chunks = rows.withColumn("last", F.greatest(F.ceil((F.col("n_bytes") - overlap) / chunk), F.lit(1)) - 1).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    start = F.col("k") * chunk
    body = F.substring(F.col("text").cast("binary"), (start + 1).cast("int"), F.lit(chunk + overlap))
    chunks = chunks.select("doc_id", "ha", "hb", "n_bytes", "k", (F.col("k") == F.col("last")).alias("ends"), start.alias("from"), (start + chunk + overlap).alias("upto"), body.alias("body"))
    seen = chunks.hint("rebalance").mapInArrow(_edges(path, overlap), EDGE)
    key = ["doc_id", "ha", "hb", "n_bytes"]
    side = lambda c, left: F.any_value(F.when(F.col("left") == left, F.col(c)), ignoreNulls=True)
    edges = seen.groupBy(*key, "edge").agg(F.bool_or("ends").alias("ends"), F.count_if("left").alias("copies"), *(side(c, x).alias(f"{c}_{s}") for c in ("at", "before") for x, s in ((True, "l"), (False, "r"))))
    common = F.array_min(F.array_intersect("at_l", "at_r"))
    tokens = lambda s: F.get(f"before_{s}", F.array_position(f"at_{s}", common).cast("int") - 1)
    edges = edges.select(*key, "copies", F.when(F.col("ends"), F.get("before_l", F.lit(0))).otherwise(tokens("l") - tokens("r")).alias("n"))
    return edges.groupBy(*key).agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"), F.max("copies").alias("copies"))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): the tokens of each whole text as the library gives them, and whether they are over the limit."""
    byte_level(path)
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counts = rows.filter(F.col("n_bytes") <= chunk + overlap).select("doc_id", "n_bytes", "text").mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long")
    long = rows.filter(F.col("n_bytes") > chunk + overlap).withColumns({"ha": F.xxhash64("doc_id", "text"), "hb": F.xxhash64(F.lit(1), "doc_id", "text")})
    todo = long
    while True:
        found = written(_spliced(todo, path, chunk, overlap), "counts")
        done = found.filter("n_tokens is not null")
        counts = counts.unionByName(done.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "n_bytes", "n_tokens"))
        open_ = found.filter("n_tokens is null")
        if open_.isEmpty():
            break
        todo = long.join(open_.select("ha", "hb"), ["ha", "hb"], "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
