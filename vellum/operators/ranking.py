"""Order within large groups: row numbers, medians and running values, without a task that holds a whole group.

The rows of large groups are dealt to cells that are intervals of the order (group, keys), so that what crosses a border can be added
from a table of one row a cell: a window inside each cell, a window over the cells, and a join of the two.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group from which it is cut, and about the size of a cell.
ROWS = 1 << 20
#: Cells that are looked for at most; each is a row on the driver and a literal in the plan.  Beyond that cells grow.
MOST = 1024
CELL = "_cell"


def same(rows: DataFrame, table: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with table on equal columns, null equal to null; table's copies of the columns go."""
    named = table.select(*(F.col(f"`{c}`").alias(f"_of_{c}") if c in columns else F.col(f"`{c}`") for c in table.columns))
    on = F.lit(True)
    for c in columns:
        on &= F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`"))
    return rows.join(named, on, how).drop(*(f"_of_{c}" for c in columns))


def _cell_of(place: Column, borders: set[tuple], kind: T.StructType) -> Column:
    """How many of the borders are not above a place, by binary search in a literal."""
    if not borders:
        return F.lit(0)
    table = F.sort_array(F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind, strict=True))) for b in borders)))
    n = len(borders)

    def step(at: Column, k: Column) -> Column:
        return F.when((at + k <= n) & (F.get(table, at + k - 1) <= place), at + k).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length())))), F.lit(0), step)


def in_cells(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """df with `_cell`: about `rows` rows (ROWS) of a large group that follow each other in the order; None if no group has more.

    Borders are places (by, order) of rows, chosen by a hash.  The rows between them are counted exactly, and a cell that holds too many is cut
    again, until it fits or all its rows have one place: keys may be wide, sparse or equal, and further order columns tell equal ones
    apart.  Rows of one place are never parted, nor are groups that fit.
    """
    rows = rows or ROWS
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest, large = sizes.agg(F.max("_n"), F.sum(F.when(F.col("_n") > rows, F.col("_n")))).first()
    if (largest or 0) <= rows:
        return None
    each = max(rows, -(-large // MOST))
    place = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate((*by, *order))))
    kind = df.select(place.alias("p")).schema["p"].dataType
    some = same(df.select(*by, *order), sizes.filter(F.col("_n") > rows).select(*by), by) if by else df
    some = some.select(place.alias("p"))
    borders: set[tuple] = set()
    for turn in range(64):
        placed = some.withColumn("cell", _cell_of(F.col("p"), borders, kind))
        found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.approx_count_distinct("p").alias("d")).collect()
        wide = {r["cell"]: max(1, r["d"] * each // r["n"]) for r in found if r["n"] > 4 * each and r["lo"] != r["hi"]}
        if not wide or len(borders) > 4 * MOST:
            break
        # of a wide cell's places so many that about `each` rows lie between two, and the last one, so that every turn cuts it
        share = F.element_at(F.create_map(*(F.lit(x) for pair in wide.items() for x in pair)), F.col("cell"))
        chosen = placed.filter(F.col("cell").isin(list(wide))).filter(F.pmod(F.xxhash64("p", F.lit(turn)), share) == 0)
        borders |= {tuple(r["p"]) for r in chosen.select("p").distinct().collect()} | {tuple(r["hi"]) for r in found if r["cell"] in wide}
    return df.withColumn(CELL, _cell_of(place, borders, kind))


def before_cells(table: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """A table of one row a cell with aggregates over the earlier cells of its group."""
    w = Window.partitionBy(*by).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({k: v.over(w) for k, v in sums.items()})


def numbered(df: DataFrame, name: str, key: str, order: Sequence[str] = (), by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Adds the row number (from 1) of each row of a group `by` in ascending order of the key, then `order`; nulls first, equal places in any order."""
    keys = [key, *order]
    cut = in_cells(df, by, keys, rows)
    if cut is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("long"))
    counts = before_cells(cut.groupBy(*by, CELL).agg(F.count(F.lit(1)).alias("_n")), by, {"_before": F.sum("_n")}).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, CELL).orderBy(*keys))
    return same(cut.withColumn("_inner", inner), counts, [*by, CELL]).withColumn(name, F.col("_inner") + F.coalesce("_before", F.lit(0))).drop(CELL, "_inner", "_before")


def medians(df: DataFrame, column: str, by: Sequence[str], name: str = "median", rows: int | None = None) -> DataFrame:
    """(by..., median) of the values that are not null, as a double; between the two middle ones of an even number.

    The cells that hold the middle ranks are found by counting, and only their rows are sorted, so that no state grows with the number of distinct values.
    """
    some = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("_value"))
    cut = in_cells(some, by, ["_value"], rows)
    if cut is None:
        return some.groupBy(*by).agg(F.median("_value").alias(name))
    cells = cut.groupBy(*by, CELL).agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    cells = before_cells(cells, by, {"_before": F.sum("_n")}).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by))).withColumn("_before", F.coalesce("_before", F.lit(0)))
    middle = F.array_distinct(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))
    wanted = cells.withColumn("_at", F.explode(F.filter(F.transform(middle, lambda k: k - F.col("_before")), lambda k: (k >= 0) & (k < F.col("_n")))))
    flat = wanted.filter("_lo = _hi").select(*by, F.col("_lo").alias("_value"))
    wanted = wanted.filter("_lo <> _hi").groupBy(*by, CELL).agg(F.collect_set("_at").alias("_ranks"))
    sorted_ = same(cut, wanted, [*by, CELL]).withColumn("_at", F.row_number().over(Window.partitionBy(*by, CELL).orderBy("_value")) - 1)
    found = flat.unionByName(sorted_.filter(F.array_contains("_ranks", F.col("_at").cast("long"))).select(*by, "_value"))
    low, high = F.min("_value").cast("double"), F.max("_value").cast("double")
    return found.groupBy(*by).agg((low + (high - low) * 0.5).alias(name))
