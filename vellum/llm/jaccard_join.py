"""Operator 10: join of documents whose sets of word n-grams have a Jaccard similarity of at least the threshold.

MinHash banding: the numbers of bands and rows follow from the recall wanted at the threshold.  Documents with equal n-gram sets
stand for each other from the start.  Distinct sets that share a band are candidates, in groups of any size alike: each group
of a band is exchanged in blocks of bounded bytes, every two blocks meet in a task, and each pair is verified on
its full sets in the first band that it shares.  Bands that hold the same sets as an earlier one are left out.  No pair
leaves its task: only each set's number of links and a spanning edge for each linked set do.

Words are runs of anything but ASCII blanks; a text of 1 to n-1 words has one n-gram, all of it; a null or blank text has
none, links to nothing and is a class of its own; repeated rows and copies count as links of each other; the
class id is the smallest doc_id in it (null if all are null; classes may share it where doc_ids repeat); an empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.flat import BASE, SPREAD, U64, Rolling, flat, gather, mix, slices, spans, words
from vellum.llm.graphs import components
from vellum.llm.shared import MB, drop, hash128, join_counted, settled, spread, written

SKETCH = "doc_id long, rid struct<a: long, b: long>, node binary, size int, bands array<long>"


def banding(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows for which a pair at the threshold shares a band with probability recall."""
    rows = max(r for r in range(1, hashes + 1) if r == 1 or 1 - (1 - threshold**r) ** (hashes // r) >= recall)
    return min(hashes // rows, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def ngrams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of the distinct n-grams of each text, by text."""
    raw, offsets = flat(column)
    ws, we, before = words(raw, offsets)
    count = np.diff(before)
    roll = Rolling(Rolling(SPREAD[raw]).of(ws, we))
    doc, at = spans(np.where(count >= n, count - n + 1, np.minimum(count, 1)))
    lo = before[:-1][doc] + at
    h = roll.of(lo, lo + np.minimum(n, count[doc]))
    _, index = np.unique(mix(h + doc.astype(U64) * U64(BASE)), return_index=True)
    index.sort()
    return h[index], doc[index]


def _sketch(part: pa.RecordBatch, n: int, bands: int, rows: int) -> pa.RecordBatch:
    h, doc = ngrams(part.column("text"), n)
    texts = part.num_rows
    size = np.bincount(doc, minlength=texts)
    full = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[full]
    rng = np.random.default_rng(bands * 1000 + rows)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
    out = np.zeros((len(full), bands), U64)
    for b in range(bands):
        value = np.full(len(full), U64(b + 1))
        for r in range(rows):
            value = mix(value * U64(BASE) + np.minimum.reduceat(h * mul[b * rows + r], begin)) if len(full) else value
        out[:, b] = value
    one = np.add.reduceat(mix(h), begin) if len(full) else h[:0]
    two = np.bitwise_xor.reduceat(mix(h ^ U64(BASE)), begin) if len(full) else h[:0]
    node: list[bytes | None] = [None] * texts
    for i, a, b in zip(full.tolist(), one.tolist(), two.tolist(), strict=True):
        node[i] = a.to_bytes(8, "big") + b.to_bytes(8, "big")
    at = np.append(0, np.cumsum((size > 0) * bands)).astype(np.int32)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(node, pa.binary()), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(out.reshape(-1).view(np.int64)))], ["doc_id", "rid", "node", "size", "bands"])


def similar(hashes: np.ndarray, doc: np.ndarray, size: np.ndarray, split: int, threshold: float, columns: int = 4096) -> np.ndarray:
    """Matrix of which of the sets before split (given by distinct hashes and their set) are `threshold` alike to which of those after it; split 0: of all to all."""
    left, right = (split, len(size) - split) if split else (len(size), len(size))
    _, col, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    on = shared[col]
    row, col = doc[on], rank[col[on]]
    common = np.zeros((left, right), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [lo, lo + columns])
        x = np.zeros((len(size), min(columns, int(shared.sum()) - lo)), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        common += x[:split] @ x[split:].T if split else x @ x.T
    union = size[:left, None] + size[None, split:] - common
    out = common >= threshold * union - 1e-6
    if not split:
        np.fill_diagonal(out, False)
    return out


def _roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of 0 .. n-1 by the edges x, y."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(batches, n: int, threshold: float, most_bytes: int = 4 << 20):
    """Meetings (band, key, i, j) of blocks, rows in order -> (node, links, root) of the linked sets of each."""

    def meetings():
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t.combine_chunks()
            if not t.num_rows:
                continue
            new = np.ones(t.num_rows, bool)
            new[1:] = np.logical_or.reduce([np.diff(t[c].to_numpy()) != 0 for c in ("band", "key", "i", "j")])
            cut = np.flatnonzero(new)
            held = t.slice(int(cut[-1]))
            if len(cut) > 1:
                yield t.slice(0, int(cut[-1])), cut[:-1]
        if held is not None and held.num_rows:
            yield held, np.array([0])

    for t, cut in meetings():
        _, at = flat(t["text"])
        ends = np.append(cut[1:], t.num_rows)
        lo = 0
        while lo < len(cut):  # some meetings at a time
            hi = max(lo + 1, int(np.searchsorted(at[ends], at[cut[lo]] + most_bytes, "right")))
            part = t.slice(int(cut[lo]), int(ends[hi - 1] - cut[lo])).combine_chunks()
            yield from _some(part, cut[lo:hi] - cut[lo], ends[lo:hi] - cut[lo], n, threshold)
            lo = hi


def _some(t: pa.Table, cut, ends, n, threshold):
    h, doc = ngrams(t["text"].combine_chunks(), n)
    begin = np.searchsorted(doc, np.arange(t.num_rows + 1))
    size = np.diff(begin)
    nodes, block, copies = t["node"].to_pylist(), t["block"].to_numpy(), t["copies"].to_numpy()
    band, i, j = (t[c].to_numpy() for c in ("band", "i", "j"))
    marks = np.frombuffer(b"".join(t["marks"].to_pylist()), ">i8").reshape(t.num_rows, -1)
    out: tuple[list, list, list] = ([], [], [])
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        some = np.array(sorted({nodes[k]: k for k in range(a, b)}.values(), key=lambda k: (block[k] != i[a], nodes[k])))  # repeated rows once
        split = int(np.count_nonzero(block[some] == i[a])) if i[a] != j[a] else 0
        if len(some) < 2 or i[a] != j[a] and split in (0, len(some)):
            continue
        index = gather(begin[some], size[some])
        linked = similar(h[index], np.repeat(np.arange(len(some)), size[some]), size[some], split, threshold)
        x, y = np.nonzero(linked if split else np.triu(linked))
        y = y + split
        earlier = np.zeros(len(x), bool)  # pairs that share a band before this one were counted there
        for k in range(band[a]):
            earlier |= marks[some[x], k] == marks[some[y], k]
        x, y = x[~earlier], y[~earlier]
        root = _roots(x, y, len(some))
        links = np.bincount(x, copies[some[y]], len(some)) + np.bincount(y, copies[some[x]], len(some))
        for k in np.flatnonzero(links).tolist():
            out[0].append(nodes[some[k]]), out[1].append(int(links[k])), out[2].append(nodes[some[root[k]]])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["node", "links", "root"])


def sketches(docs: DataFrame, n: int, bands: int, rows: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _sketch(part, n, bands, rows)

    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), _row_key(id_column, text_column).alias("rid"), text.alias("text")).mapInArrow(run, SKETCH)


def _row_key(id_column: str, text_column: str):
    return hash128(F.col(id_column).cast("long"), F.coalesce(F.col(text_column), F.lit("")))


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 512, block_grams: int = 1 << 18, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, rid, label, class_id, n_links) for each row: rid names rows that are alike in id and text, label its class (null without words)."""
    bands, rows = banding(threshold, recall)
    docs = settled(docs)
    found = written(sketches(docs, n, bands, rows, id_column, text_column), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    sets = found.filter("node is not null").groupBy("node", "size").agg(F.count(F.lit(1)).alias("copies"), first, F.first("bands").alias("bands"))
    sets = written(sets.select("node", "size", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("rid"), "bands"), "sets")
    shared = sets.select("node", "size", F.posexplode("bands").alias("band", "key"))
    # groups of two sets or more; of those that hold the same sets the one of the first band is enough
    groups = shared.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("m > 1")
    groups = groups.groupBy("m", "grams", "x", "y").agg(F.min(F.struct("band", "key")).alias("g"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("grams") / block_grams)).cast("int")
    groups = written(groups.select("g.band", "g.key", "m", blocks.alias("blocks")), "groups")
    members = written(join_counted(shared.drop("size"), groups, ["band", "key"], "m", sets.count() * bands).drop("m"), "members")
    parts = spread(docs)
    # the members of a large group lie in few files: they are exchanged, as the join below needs them, before each makes a row for every other block
    placed = members.repartition(parts, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "band", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # the bands' keys tell which pairs share an earlier one
    marks = F.concat(*(F.unhex(F.lpad(F.hex(F.col("bands")[b]), 16, "0")) for b in range(bands)))
    wanted = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "copies", "rid", marks.alias("marks"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(_row_key(id_column, text_column).alias("rid"), text.alias("text")).repartition(parts, "rid")
    texts = texts.join(wanted.repartition(parts, "rid").hint("shuffle_hash"), "rid").select("node", "copies", "marks", "text")
    meetings = texts.join(placed, "node").repartition(parts, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    links = written(meetings.mapInArrow(lambda b: _verified(b, n, threshold), "node binary, links long, root binary"), "links")
    drop(members, groups)
    label = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = sets.select("node", "copies", "first_id").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = per.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    nodes = written(per.select("node", "copies", "first_id", "label", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "nodes")
    # a large class, or a large group of copies, is a frequent key
    named = written(nodes.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("nodes")), "named")
    per = written(join_counted(nodes.drop("first_id"), named, ["label"], "nodes", nodes.count()).select("node", "copies", "label", "class_id", "n_links"), "classes")
    drop(sets, links, nodes, named)
    out = join_counted(found.select("doc_id", "rid", "node"), per, ["node"], "copies", found.count()).select("doc_id", "rid", "label", "class_id", "n_links")
    none = found.filter("node is null").select("doc_id", "rid", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none)


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) for each row; options as for classes()."""
    return classes(docs, **options).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (null last), then by hash; once if it is repeated.

    Classes are told apart by their label, so that classes which share a doc_id, or have none, keep a row each.  Rows without words all stay.
    """
    text_column, id_column = options.get("text_column", "text"), options.get("id_column", "doc_id")
    docs = settled(docs)
    rows = written(classes(docs, **options).filter("label is not null").select("doc_id", "rid", "label"), "classes")
    kept = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")).select(F.col("first.rid").alias("_vellum_rid"))
    kept = written(kept, "kept")
    repeated = not rows.join(kept, rows["rid"] == kept["_vellum_rid"], "left_semi").groupBy("rid").count().filter("count > 1").isEmpty()
    drop(rows)
    parts = spread(docs, 8 * MB)
    keyed = docs.withColumn("_vellum_rid", _row_key(id_column, text_column)).repartition(parts, "_vellum_rid")
    out = keyed.join(kept.repartition(parts, "_vellum_rid").hint("shuffle_hash"), "_vellum_rid", "left_semi")
    out = out.dropDuplicates(["_vellum_rid"]) if repeated else out
    blank = docs.filter(~F.coalesce(F.col(text_column), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns).unionByName(blank)
