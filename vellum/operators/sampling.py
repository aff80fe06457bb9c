"""Exact-size random splits that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split(df: DataFrame, key: str, parts: dict[str, float], seed: str = "", limit: int | None = None) -> DataFrame:
    """Adds `part`: rows in order of md5(seed + key), then key; the first floor(n * share) rows are the first part, and so on, the rest the last.

    Rows are counted by the first three hexadecimal digits of the hash (4096 cells, whatever the input); only the
    cells that hold a border, about n / 4096 rows each, are ordered.  limit: first keep so many rows of that order.
    """
    rows = df.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))).withColumn("_cell", F.substring("_hash", 1, 3))
    counts = {r[0]: r[1] for r in rows.groupBy("_cell").count().collect()}
    n = sum(counts.values())
    total = n if limit is None else min(n, limit)
    borders, at = [], 0
    names = list(parts)
    for name in names[:-1]:
        at = min(total, at + int(total * parts[name] + 1e-9))
        borders.append(at)
    borders.append(total)
    before, run = {}, 0
    for c in sorted(counts):
        before[c], run = run, run + counts[c]
    # the cell that holds each part's last row, and how many of its rows belong to the part
    last = []
    for b in borders:
        cell = max((c for c in before if before[c] < b), default="")
        last.append((cell, b - before.get(cell, 0)))
    mixed = sorted({c for c, k in last if c and k < counts[c]})

    def parted(inner: Column) -> Column:
        part = F.lit(None).cast("string")
        for name, (c, k) in reversed(list(zip(names, last, strict=True))):
            part = F.when((F.col("_cell") < c) | ((F.col("_cell") == c) & (inner <= k)), F.lit(name)).otherwise(part)
        return part

    whole = rows.filter(~F.col("_cell").isin(mixed)).withColumn("part", parted(F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", key))
    some = rows.filter(F.col("_cell").isin(mixed)).withColumn("_place", place)
    out = whole.unionByName(some.withColumn("part", parted(F.col("_place"))).drop("_place")).drop("_hash", "_cell")
    return out.filter("part is not null") if limit is not None else out


def train_validation_test(df: DataFrame, key: str, reserved: float = 0.2, seed: str = "", limit: int | None = None) -> DataFrame:
    """The test share first, then the validation share of the rest: .64 / .16 / .20 by default."""
    first = split(df, key, {"rest": 1 - reserved, "test": reserved}, seed, limit).withColumnRenamed("part", "_first")
    rest = split(first.filter("_first = 'rest'"), key, {"train": 1 - reserved, "validation": reserved}, seed + "2").drop("_first")
    return rest.unionByName(first.filter("_first = 'test'").drop("_first").withColumn("part", F.lit("test")))


def duration_estimate(done: Column, total: Column, seconds: Column) -> Column:
    """Seconds left, from what part has been done in so many seconds."""
    return F.when(done > 0, seconds * (total - done) / done)
