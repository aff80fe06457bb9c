"""The pipeline against the brute force of its stages, one after the other."""

from __future__ import annotations

import collections
import zlib

import numpy as np
from test_operators import ROWS, SCHEMA, brute_one_of_each, brute_quality, text

import corpus_pipeline
from vellum.llm.encoders import tokenizer_path
from vellum.llm.shared import written


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "repeated_substrings", "packed_sequences"]

    docs = written(stages["quality_rules"](spark, docs, path), "t")
    rows = [(r[0], kept, *r[2:]) for r, (v, kept) in zip(rows, brute_quality(rows), strict=True) if v[8]]
    assert docs.columns == columns
    assert sorted((repr(r.doc_id), r.text, r.n_chars) for r in docs.collect()) == sorted((repr(r[0]), r[1], len(r[1])) for r in rows)

    docs = written(stages["near_duplicates"](spark, docs, path), "t")
    want = brute_one_of_each(rows)
    got = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()]
    assert docs.columns == columns and len(got) == len(want) and all(any(x in one for x in got) for one in want)

    rows = [tuple(r) for r in docs.collect()]
    raw = [text(r).encode() for r in rows]
    docs = written(stages["repeated_substrings"](spark, docs, path), "t")
    count: dict = {}
    for b in raw:
        for k in range(len(b) - 199):
            count[b[k : k + 200]] = count.get(b[k : k + 200], 0) + 1
    want = []
    for r, b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((repr(r[0]), np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore")))
    assert docs.columns == columns and sorted((repr(r.doc_id), r.text) for r in docs.collect()) == sorted(want)

    # the pieces of run() are those of the texts that the stages keep, each id in one piece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    pieces = collections.defaultdict(list)
    packed = corpus_pipeline.run(spark, path).collect()
    for r in packed:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for name, found in pieces.items():
        assert sum(r.length for r in found) == sum(map(len, ids[name]))
        for r in found:
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[name])
        if len(ids[name]) == 1:
            found.sort(key=lambda r: r.start)
            assert [r.start for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
    used = collections.defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
