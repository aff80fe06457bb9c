"""Descriptions of pages and line samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import ranking

def described(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Mean, median, smallest and largest of each column, cut to whole numbers, in columns `<column>_<measure>`, and n.

    Spark's exact median keeps the distinct values of a group; where a group has more than `rows` rows (ranking.ROWS), it is found by ranking.medians() instead.
    """
    cut = lambda c: F.floor(c).cast("long")
    measures = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    made = lambda names: [cut(measures[m](F.col(c))).alias(f"{c}_{m}") for c in columns for m in names]
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= (rows or ranking.ROWS):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *made(measures))
    keys = list(by) or ["_every"]
    if not by:
        df = df.withColumn("_every", F.lit(True))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *made([m for m in measures if m != "median"]))
    for c in columns:
        out = ranking.same(out, ranking.medians(df, c, keys, f"{c}_median", rows), keys, "left").withColumn(f"{c}_median", cut(F.col(f"{c}_median")))
    return out.select(*by, "n", *(f"{c}_{m}" for c in columns for m in measures))


def summary(df: DataFrame, title: str = "") -> str:
    """A text for people: the title, the number of rows, and each column's type and number of values."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(df[f"`{c}`"]).alias(f"c{k}") for k, c in enumerate(df.columns))).first()
    return "\n".join([f"{title or 'table'}: {counts['n']} rows", *(f"  {c}: {kind}, {counts[f'c{k}']} values" for k, (c, kind) in enumerate(df.dtypes))])


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; larger inputs stay as they are read, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys..., line_pos, text) of the \\n-separated lines."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_pos", "text"))


def page_lengths(found: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys..., n_lines, gt_length): lines and characters of each page."""
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("gt_length"))
