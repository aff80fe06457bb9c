"""Operator 9: quality rules with cross-document line frequency.

Lines are normalised (lower case, blanks collapsed, ends stripped) and hashed.  For each host the distinct documents that hold a
line are counted; exact copies of a text are one document, so that copies alone never make a text look like boilerplate, and
texts that differ in anything are two.  Lines in more than `limit` documents of a host are removed; the limit is a
fixed number, so that boilerplate goes on hosts of every size.  Documents that keep less than keep_share of their words
are rejected, as are those that fail the base rules (n_words < 50, or repeated words).

Null texts count as empty (and fail the base rules); a null host is a host of its own; repeated rows get equal results;
an empty table gives no rows.  Further columns are ignored by facts() and verdicts() and kept by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.flat import BASE, SPREAD, U64, Rolling, flat, mix, slices, spans, words
from vellum.llm.shared import MB, hash128, join_counted, settled, spread, written

#: Lines in more than 6 documents of a host go, the number that published line-level deduplication of web corpora uses for a
#: bucket; documents that lose more than a quarter of their words are depleted.
LIMIT, KEEP_SHARE = 6, 0.75
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
PAIR = "struct<a: long, b: long>"
FACTS = f"rid {PAIR}, doc_id long, host long, text_hash {PAIR}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: int, places: array<int>>>"
NAMES = ["rid", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of all texts; an empty text has one empty line."""
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return starts, ends


def _line_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    breaks = np.append(0, np.cumsum(raw == 0x0A))
    return np.diff(breaks[offsets]) + 1


def line_hashes(column: pa.Array):
    """For each line with a word, in order: its text's number, its place among the text's lines, its hash, its words."""
    raw, offsets = flat(pc.utf8_lower(column))
    ws, we, _ = words(raw, offsets)
    ls, le = _lines(raw, offsets)
    lo, hi = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    doc, place = spans(_line_counts(raw, offsets))
    hashes = Rolling(Rolling(SPREAD[raw]).of(ws, we)).of(lo, hi)
    full = hi > lo
    return doc[full], place[full], hashes[full], (hi - lo)[full]


def _facts(part) -> pa.RecordBatch:
    raw, offsets = flat(part.column("text"))
    n = len(offsets) - 1
    ws, we, before = words(raw, offsets)
    n_words = np.diff(before)
    head = np.append(0, np.cumsum(((raw & 0xC0) != 0x80) & ((raw > 0x20) | (raw < 0x09) | ((raw > 0x0D) & (raw < 0x20)))))
    symbols = np.append(0, np.cumsum(SYMBOLS[raw]))
    # words in 3-word windows that occur twice or more in their text
    roll = Rolling(Rolling(SPREAD[raw]).of(ws, we))
    doc, at = spans(n_words)
    first = np.flatnonzero(at + 3 <= n_words[doc])
    key = mix(roll.of(first, first + 3) + doc[first].astype(U64) * U64(BASE))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(len(ws) + 3, bool)
    for k in range(3):
        marked[first[twice] + k] = True
    repeats = np.append(0, np.cumsum(marked[: len(ws)]))
    # lines with a word that equal an earlier line of the text
    ls, le = _lines(raw, offsets)
    ldoc = np.repeat(np.arange(n), _line_counts(raw, offsets))
    full = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    lkey = mix(Rolling(SPREAD[raw]).of(ls[full], le[full]) + ldoc[full].astype(U64) * U64(BASE))
    _, which = np.unique(lkey, return_index=True)
    dups = np.bincount(ldoc[full], minlength=n) - np.bincount(ldoc[full][which], minlength=n)
    # distinct normalised lines, with all their words in the text and their places among its lines
    d, place, h, w = line_hashes(part.column("text"))
    order = np.lexsort((h, d))
    d, h, w, place = d[order], h[order], w[order], place[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    total = np.add.reduceat(w, begin) if len(begin) else w
    to = np.append(0, np.cumsum(np.bincount(d[begin], minlength=n))).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(d)).astype(np.int32)), pa.array(place.astype(np.int32)))
    lines = pa.StructArray.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(total.astype(np.int32)), places], ["line", "words", "places"])
    counts = (pa.array(x.astype(np.int64)) for x in (n_words, np.diff(head[offsets]), np.diff(symbols[offsets]), dups, np.diff(repeats[before])))
    return pa.RecordBatch.from_arrays([*(part.column(x) for x in NAMES[:4]), *counts, pa.ListArray.from_arrays(pa.array(to), lines)], NAMES)


def _row_key(id_column: str, text_column: str, host_column: str):
    return hash128(F.col(id_column).cast("long"), F.coalesce(F.col(host_column), F.lit("\0")), F.coalesce(F.col(text_column), F.lit("")))


def facts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """FACTS for each row, as a written table without the texts.  host and text_hash are hashes; rid names rows that are alike in id, host and text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _facts(part)

    text, host = F.coalesce(F.col(text_column), F.lit("")), F.coalesce(F.col(host_column), F.lit("\0"))
    rows = docs.select(_row_key(id_column, text_column, host_column).alias("rid"), F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(host).alias("host"), hash128(text).alias("text_hash"), text.alias("text"))
    return written(rows.mapInArrow(run, FACTS), "facts")


def frequent_lines(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(rid, words, places): the lines above the limit of its host that a row holds, a row for each line."""
    # one row for each distinct text of a host: copies have equal lines
    texts = found.select("host", "text_hash", F.transform("lines", lambda x: x["line"]).alias("lines")).groupBy("host", "text_hash", "lines").agg(F.count(F.lit(1)).alias("copies"))
    counts = texts.select("host", "copies", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("times"))
    above = written(counts.filter(F.col("docs") > limit).select("host", "line", "times"), "above")
    total = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    held = found.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.*")
    return join_counted(held, above, ["host", "line"], "times", total).select("rid", "line", "words", "places").distinct()


def _losses(found: DataFrame, limit: int) -> DataFrame:
    """(rid, n_removed_words, places) of the rows that lose lines."""
    return frequent_lines(found, limit).groupBy("rid").agg(F.sum("words").alias("n_removed_words"), F.flatten(F.collect_list("places")).alias("places"))


def verdicts(found: DataFrame, limit: int = LIMIT, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The base columns of each row, n_removed_words, the places of the lines to remove, base_failed and kept."""
    out = found.drop("lines", "host", "text_hash").join(_losses(found, limit), "rid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return out.select("rid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "places", failed.alias("base_failed"), (~failed & (left >= keep_share * F.col("n_words"))).alias("kept"))


def clean(docs: DataFrame, limit: int = LIMIT, keep_share: float = KEEP_SHARE, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", part_bytes: int = 8 * MB) -> DataFrame:
    """docs without the rejected rows, and without the frequent lines of the others; all columns stay.

    The decisions are a narrow table, a row for each row kept with the places of the lines to remove.  Texts are exchanged once
    to meet them, into parts of bounded bytes, and are neither sorted nor sent to Python.
    """
    docs = settled(docs)
    kept = written(verdicts(facts(docs, id_column, text_column, host_column), limit, keep_share).filter("kept").select(F.col("rid").alias("_vellum_rid"), F.col("places").alias("_vellum_places")).distinct(), "kept")
    n = spread(docs, part_bytes)
    rows = docs.withColumn("_vellum_rid", _row_key(id_column, text_column, host_column)).repartition(n, "_vellum_rid")
    rows = rows.join(kept.repartition(n, "_vellum_rid").hint("shuffle_hash"), "_vellum_rid")
    left = F.filter(F.split(F.col(text_column), "\n", -1), lambda x, i: ~F.array_contains("_vellum_places", i))
    text = F.when(F.col("_vellum_places").isNull(), F.col(text_column)).otherwise(F.array_join(left, "\n"))
    return rows.withColumn(text_column, text).select(*docs.columns)
