"""Operator 3: sentencepiece encoding and decoding in vectorised merge rounds (merges.py, encoders.py).

Each text is encoded with begin and end id, whole; null counts as empty; rows are independent, so ties, repeated rows
and further columns change nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.encoders import encoder
from vellum.llm.flat import slices


def _ragged(kind: pa.DataType, values, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), *values])


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids with begin and end id, and the text decoded from them."""

    def run(batches):
        piece = encoder(model)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, at = piece.framed(part.column("text"))
                raw, to = piece.decode(ids, at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, _ragged(pa.string(), [pa.py_buffer(raw)], to)], ["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"`{text_column}` text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same, without carrying ids and texts back."""

    def run(batches):
        piece = encoder(model)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, at = piece.framed(part.column("text"))
                raw, to = piece.decode(ids, at)
                words, text = memoryview(ids.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(raw))
                one = [hashlib.sha256(words[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                two = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
