"""Operator 4: token ids in files of directly addressable codes.

An id is split into chunks of `bits` bits, lowest first.  Level k holds, for all ids that have one, their chunk k; a
bitmap beside it says which go on to level k+1, and a rank directory (ones before each 512th bit)
says where.  So any token is found with one step a level, and no block is decoded.  Documents are exchanged into
ranges of their order, by exact counts of bytes; a range is passed over in order and closes a file whenever it has
enough tokens, so that none is held whole.  A manifest lists the files.

Null texts count as empty; a null doc_id comes first; repeated rows are documents of their own; equal doc_ids stand in
the order of a hash of their texts, so that one id may fill many ranges; ids may have any sign and lie as far
apart as they can; an empty table gives no files and no rows.  Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import files
from vellum.llm.encoders import encoder, with_end
from vellum.llm.flat import slices
from vellum.llm.shared import MB, drop, fresh, in_ranges, order_key, ranges, written

MAGIC, DIRECTORY = b"VDAC0001", 512


def dac_encode(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (chunks, packed bitmap, rank directory) of unsigned ids under 2**32."""
    out, rest = [], np.asarray(ids, np.uint32)
    kind = np.uint8 if bits <= 8 else np.uint16
    while True:
        more = rest >= 1 << bits
        packed = np.packbits(more, bitorder="little")
        ones = np.bincount(np.flatnonzero(more) // DIRECTORY, minlength=len(rest) // DIRECTORY + 1)
        out.append(((rest & (1 << bits) - 1).astype(kind), packed, np.append(0, np.cumsum(ones)[:-1]).astype(np.uint64)))
        rest = rest[more] >> bits
        if not len(rest):
            return out


class Dac:
    """Random access to the ids of encoded levels."""

    def __init__(self, levels, bits: int = 8):
        self.levels, self.bits = levels, bits

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a level's bitmap."""
        _, packed, ranks = self.levels[level]
        block = i // DIRECTORY
        lo = block * DIRECTORY // 8
        tail = np.unpackbits(packed[lo : (i + 7) // 8], bitorder="little")[: i - block * DIRECTORY]
        return int(ranks[block]) + int(tail.sum())

    def get(self, i: int) -> int:
        """Token i."""
        value = 0
        for k, (chunks, packed, _) in enumerate(self.levels):
            value |= int(chunks[i]) << k * self.bits
            if not packed[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo .. hi-1."""
        out = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for k, (chunks, packed, _) in enumerate(self.levels):
            if lo >= hi:
                break
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(k * self.bits)
            byte = lo >> 3
            more = np.unpackbits(packed[byte : (hi + 7) // 8], bitorder="little")[lo - 8 * byte : hi - 8 * byte].astype(bool)
            where = where[more]
            lo = self._rank(k, lo)
            hi = lo + len(where)
        return out


def dump(doc_ids: pa.Array, at: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """A file: header, doc_ids and which of them are null, their first tokens, levels."""
    levels = dac_encode(ids, bits)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    parts = [MAGIC, struct.pack("<QQII", len(doc_ids), len(ids), bits, len(levels)), doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(null).tobytes(), at.astype("<u8").tobytes()]
    for chunks, packed, ranks in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), packed.tobytes(), ranks.tobytes()]
    return b"".join(parts)


def load(data: bytes) -> tuple[pa.Array, np.ndarray, Dac]:
    """(doc_ids, their first tokens and the end, the ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, _, bits, count = struct.unpack_from("<QQII", data, 8)
    place = 32

    def take(kind, n):
        nonlocal place
        out = np.frombuffer(data, kind, n, place)
        place += out.nbytes
        return out

    names, null, at = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool), take("<u8", docs + 1).astype(np.int64)
    levels = []
    for _ in range(count):
        (n,) = take("<u8", 1).tolist()
        levels.append((take("u1" if bits <= 8 else "<u2", n), take("u1", -(-n // 8)), take("<u8", n // DIRECTORY + 1)))
    return pa.array(names, mask=null), at, Dac(levels, bits)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, range_bytes: int = 4 * MB, file_tokens: int = 1 << 21, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the files of docs under path and returns the manifest (range, file, path, n_docs, n_tokens, first_token)."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    docs = docs.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    keys = written(docs.select("key", (F.octet_length("text") + 1).cast("long").alias("size")), "keys")
    cuts = ranges(keys, range_bytes)
    drop(keys)

    def run(batches):
        number, made, names, ids, sizes, tokens = 0, 0, [], [], [], 0

        def close():
            nonlocal made, tokens
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            name = f"{path}/tokens-{number:07d}-{made:05d}.dac"
            with files.committed(name) as f:
                f.write(dump(pa.concat_arrays(names), np.append(0, np.cumsum(size)), flat))
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([number << 24 | made]), pa.array([name]), pa.array([len(size)]), pa.array([len(flat)])], ["range", "file", "path", "n_docs", "n_tokens"])
            made, tokens = made + 1, 0
            for x in (names, ids, sizes):
                x.clear()
            return out

        for batch in batches:
            for x in slices(batch, "text", min(4 << 20, 4 * file_tokens)):
                number = x.column("range")[0].as_py()
                a, at = with_end(*encoder(tokenizer).encode(x.column("text")), end_id)
                names.append(x.column("doc_id")), ids.append(a.astype(np.uint32)), sizes.append(np.diff(at))
                tokens += len(a)
                if tokens >= file_tokens:
                    yield close()
        if ids:
            yield close()

    rows = in_ranges(docs, cuts).sortWithinPartitions("key", "text").select("doc_id", "text", "range")
    made = written(rows.mapInArrow(run, "range int, file long, path string, n_docs long, n_tokens long"), "files")
    manifest = written(running(made, "file", "n_tokens", "first_token", 1 << 24), "manifest")
    drop(made)
    return manifest


def running(table: DataFrame, key: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Adds the sum of value over smaller keys, in two levels so that no task orders all rows."""
    coarse = F.floor(F.col(key) / block)
    sums = table.groupBy(coarse.alias("_block")).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = table.withColumn("_block", coarse).join(sums, "_block")
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_block", "_before")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches):
        for batch in batches:
            for name, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                docs, at, dac = load(files.read(name))
                crc = []
                for lo in range(0, len(docs), 512):
                    hi = min(lo + 512, len(docs))
                    view = memoryview(dac.slice(int(at[lo]), int(at[hi])).astype("<u4")).cast("B")
                    bound = (4 * (at[lo : hi + 1] - at[lo])).tolist()
                    crc += [zlib.crc32(view[a:b]) for a, b in zip(bound, bound[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    count = (manifest.agg(F.max("range")).first()[0] or 0) + 1
    return manifest.select("path", "first_token", "range").repartitionById(count, "range").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read(write(docs, tokenizer, fresh(docs.sparkSession, "tokens"), end_id))
