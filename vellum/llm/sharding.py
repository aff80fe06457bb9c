"""Operator 8: shards of nearly equal bytes by histogram sort, in DataFrame operations only.

Rows have the key (hash of the text, doc_id), so that equal texts stand together.  Splitters between shards, and between
parts of a shard that one task can sort, are found by counting the exact bytes below candidate keys and probing
again inside the cells that hold a target, until each splitter is within the tolerance; a group of equal texts is cut
only where no place outside it is close enough.  Then one exchange puts each row into the part that the splitters give
it, where rows are sorted; the place of a row in its shard follows from the order there and the counts of the parts before.

Null texts have size 1 and count as empty; null doc_ids sort as the smallest; rows with equal keys stay together
(they are interchangeable); an empty table gives no rows.  The law is `bytes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import MB, cell_of, drop, fixed, splitters, spread, written


def sort_key(text: Column, doc_id: Column) -> Column:
    """16 bytes whose order is that of (hash of the text, doc_id)."""
    return F.unhex(F.concat(fixed(F.xxhash64(text)), fixed(F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))))))


def cuts(keys: DataFrame, shards: int, parts: int, tolerance: float = 0.01) -> tuple[list[bytes], list[int]]:
    """(splitters, the shard of each part): `parts` parts a shard, of about equal bytes.  keys has (key, size).

    Borders of shards are within tolerance * a shard's bytes of their places, those of parts within a quarter of a part.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    main = splitters(keys, [total * i / shards for i in range(1, shards)], tolerance * total / shards)
    if not main or parts == 1:
        return main, list(range(len(main) + 1))
    n = shards * parts
    inner = sorted(set(splitters(keys, [total * i / n for i in range(1, n) if i % parts], total / n / 4, 8)) - set(main))
    every = sorted([*((c, 1) for c in main), *((c, 0) for c in inner)])
    shard = [0]
    for _, border in every:
        shard.append(shard[-1] + border)
    return [c for c, _ in every], shard


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, part_bytes: int = 8 * MB, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs' rows as (doc_id, size, text_crc32, law, shard, slot, grown_shard), slots in order of the key."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key(text, F.col(id_column)).alias("key"))
    rows = written(rows, "sizes")
    found, shard_of = cuts(rows, shards, -(-spread(rows, part_bytes) // shards), tolerance)
    # the one exchange, by the splitters
    placed = rows.withColumn("part", cell_of(found, F.col("key"))).repartitionById(len(shard_of), "part").sortWithinPartitions("key")
    placed = placed.select("doc_id", "size", "text_crc32", "part", F.monotonically_increasing_id().alias("id"))
    placed = written(placed, "placed")
    drop(rows)
    # a row for each part
    runs = sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect(), key=lambda r: r["part"])
    seen = [0] * (shards + 1)
    base = []
    for r in runs:
        at = shard_of[r["part"]]
        base.append((r["part"], at, seen[at] - r["first"]))
        seen[at] += r["n"]
    base = docs.sparkSession.createDataFrame(base, "part int, shard int, base long")
    return placed.join(F.broadcast(base), "part").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("id") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
