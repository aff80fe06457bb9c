"""What the operators share: the cluster's shared folder, tables written to it, sizing, and ranges of an order."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
_own: dict[str, str] = {}  # application -> its temporary folder, where spark.checkpoint.dir is unset


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir.  Where that is unset, a temporary one on a local master, and an error on any other."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="vellum-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], True)
        found = _own[sc.applicationId]
    return f"{found.rstrip('/')}/vellum-{sc.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, survives lost executors.  drop() deletes it."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more."""
    for t in tables:
        remove(t.sparkSession, t._vellum_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file systems, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Deletes all that this application's operators keep in the shared folder; for use when their results have been stored."""
    remove(spark, shared_dir(spark))


#: Plans whose size Catalyst takes from stored files; for others it multiplies guesses, such as both sides of a join.
SIZED = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation"}


def plain_scan(df: DataFrame) -> bool:
    """Does df only select and filter stored rows?"""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in SIZED:
        if plan.children().isEmpty():
            return True
        plan = plan.children().head()
    return False


def settled(df: DataFrame) -> DataFrame:
    """df itself if it only selects and filters stored rows, else written: for those who pass over df several times and split work by its size."""
    return df if plain_scan(df) else written(df, "settled")


def input_bytes(df: DataFrame) -> int:
    """Stored bytes of df: Catalyst's figure for a plain scan, for any other plan the bytes of its strings, counted; used only to choose how finely work is split."""
    if plain_scan(df):
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    sizes = [F.coalesce(F.octet_length(df[f"`{c}`"]), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum(sizes, F.lit(8)))).first()[0] or 0


def pieces_for(df: DataFrame, each: int, least: int = 1) -> int:
    """How many parts of about `each` stored bytes df makes."""
    return max(least, math.ceil(input_bytes(df) / each))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, each: int = 16 * MB) -> int:
    """Partitions for an exchange of df: the session's number, more where a partition would hold over `each` stored bytes."""
    return pieces_for(df, each, partitions(df.sparkSession))


#: A key that more than this share of all rows have is frequent: fewer keys than this can be.
SHARE = 4096


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """Inner join of rows with a stored table of one row a key, whose column `times` says how many of the `total` rows have the key.

    The frequent keys are fewer than SHARE by their counts, so they are broadcast and their rows stay where they are; the
    others are joined by any plan, no key of them holding over a SHARE-th of all rows.  Null keys meet nothing.
    """
    frequent = F.broadcast(table.filter(F.col(times) * SHARE > total))
    others = rows.join(frequent.select(*on), on, "left_anti").join(table.filter(F.col(times) * SHARE <= total), on)
    return rows.join(frequent, on).unionByName(others)


def fixed(value: Column) -> Column:
    """A long as 16 hexadecimal digits in the order of the numbers."""
    return F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def hash128(*columns: Column) -> Column:
    """128 bits of some columns: two hashes that begin apart, so that even 10**12 rows stay distinct."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def order_key(number: Column, text: Column) -> Column:
    """Rows by (id, hash of the text), null ids first, as binary keys of 17 bytes; rows that share an id part by their texts."""
    return F.unhex(F.concat(F.when(number.isNull(), "00").otherwise("01"), fixed(F.coalesce(number, F.lit(0))), fixed(F.xxhash64(text))))


def cell_of(cuts: list[bytes], key: Column) -> Column:
    """How many of the sorted cuts (of one width) are not above the binary key, by binary search in one literal."""
    if not cuts:
        return F.lit(0)
    width, table = len(cuts[0]), F.lit(b"".join(cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))

    def step(at: Column, k: Column) -> Column:
        to = at + k
        return F.when((to <= len(cuts)) & (F.substring(table, (to - 1) * width + 1, F.lit(width)) <= key), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def splitters(keys: DataFrame, targets: list[float], slack: float, probes: int = 16, rounds: int = 64) -> list[bytes]:
    """For each target (ascending) a binary key below which about so much of `size` lies.  keys has (key, size).

    Histogram sort: exact bytes below candidate keys are counted, and each cell that holds an open target is probed
    again, until the nearer border of the target's cell is within the slack or the cell is a single key.  A round brings a
    row for each cell to the driver, at most (targets + 1) * (probes + 1) of them.  A result may lie above all keys.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    width, number = len(low), lambda b: int.from_bytes(b, "big")
    low, high = number(low), number(high)
    found: dict[int, int] = {}
    n = (len(targets) + 1) * probes
    bounds = sorted({low + (high - low) * k // n for k in range(1, n)})
    for _ in range(rounds):
        cells = keys.groupBy(cell_of([b.to_bytes(width, "big") for b in bounds], F.col("key")).alias("cell")).agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        cells.sort(key=lambda r: r["cell"])
        open_: set[tuple[int, int]] = set()
        at, begin = 0, 0
        for i, target in enumerate(targets):
            while at < len(cells) and begin + cells[at]["b"] <= target:
                begin += cells[at]["b"]
                at += 1
            if i in found:
                continue
            if at == len(cells):
                found[i] = high + 1
                continue
            end, lo, hi = begin + cells[at]["b"], number(cells[at]["lo"]), number(cells[at]["hi"])
            if lo == hi or min(target - begin, end - target) <= slack:
                found[i] = lo if target - begin <= end - target else hi + 1
            else:
                open_.add((lo, hi))
        if not open_:
            return [min(found[i], (1 << 8 * width) - 1).to_bytes(width, "big") for i in range(len(targets))]
        bounds = sorted({lo + (hi - lo) * k // probes for lo, hi in open_ for k in range(probes + 1)} | {hi + 1 for _, hi in open_ if hi < high})
    raise RuntimeError(f"splitters did not settle in {rounds} rounds")


def ranges(keys: DataFrame, each: int, most: int = 1 << 16) -> list[bytes]:
    """Cuts between consecutive ranges of about `each` bytes; keys has (key, size).

    The cuts follow from the rows alone, not from their partitions.  Beyond `most` ranges the ranges grow instead, since
    each cut is a row on the driver; those who use them pass over a range in order and hold no range whole.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = min(most, max(1, round(total / each)))
    return sorted(set(splitters(keys, [total * i / n for i in range(1, n)], total / n / 4, 8))) if n > 1 else []


def in_ranges(df: DataFrame, cuts: list[bytes]) -> DataFrame:
    """df exchanged by its binary `key`, a partition for each range; adds the range."""
    return df.withColumn("range", cell_of(cuts, F.col("key"))).repartitionById(len(cuts) + 1, "range")
