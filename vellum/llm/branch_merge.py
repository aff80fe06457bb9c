"""Operator 13: three-way merge of rows that two branches have edited, in native expressions.

A row holds the base and what both branches made of it, and is merged where it lies: its lines go through transform() with their index
into structs of the merged state, counters come from an aggregate() over these, and flatten() and array_join() give the text.
Nothing is exploded, exchanged or collected, and no Python runs.

Separate units are each column, each line, and each gap after a line, even a dropped one.  A change on one side, or the same on both, is
clean; two different ones are a conflict, in which the right branch's state holds: edit against edit, edit against drop of a
line, or insertion against insertion in a gap.  A branch that drops the row drops all of it: clean, unless the other keeps the
row with changes, which is one conflict of the whole row; nothing else of the row counts then.

Nulls become empty first; an empty text is one empty line.  Every row is merged by itself: repeated rows give repeated results.  A null id is written as empty
in names, and its added row's id is null.  An empty table gives no rows; further columns are not kept.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


#: What became of a unit; the last three are conflicts.
SAME, CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT = range(5)


def kind_of(base: Column, left: Column, right: Column) -> Column:
    """What became of a column or a line; a null is a dropped line."""
    apart = F.when(left.isNull() | right.isNull(), F.lit(EDIT_DELETE)).otherwise(F.lit(EDIT_EDIT))
    both = F.when(left.eqNullSafe(base) | left.eqNullSafe(right), F.lit(CLEAN)).otherwise(apart)
    return F.when(~right.eqNullSafe(base), both).when(left.eqNullSafe(base), F.lit(SAME)).otherwise(F.lit(CLEAN))


def kind_of_gap(left: Column, right: Column) -> Column:
    """What became of a gap, or of a row that branches may add; null is nothing."""
    return F.when(left.isNull() & right.isNull(), F.lit(SAME)).when(left.isNull() | right.isNull() | (left == right), F.lit(CLEAN)).otherwise(F.lit(INSERT_INSERT))


def winner(base: Column, left: Column, right: Column) -> Column:
    return F.when(right.eqNullSafe(base), left).otherwise(right)


def _counts(kinds: Sequence[Column], start: Column | None = None) -> Column:
    """COUNTS of some kinds, added to start."""
    add = lambda k: sum((F.when(x == k, F.lit(1)).otherwise(F.lit(0)).cast("long") for x in kinds), start[COUNTS[k - 1]] if start is not None else F.lit(0).cast("long"))
    return F.struct(*(add(k).alias(COUNTS[k - 1]) for k in (CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT)))


def merge(rows: DataFrame, id_column: str, columns: Sequence[str], lines: str = "lines", left: str = "left", right: str = "right") -> DataFrame:
    """(id, columns..., lines, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) of every id ever present; an absent row has nulls.

    rows: the id, the base's `columns` (strings) and `lines` (array<string>), and of each branch, here the one called left:
    left_dropped boolean, whether it drops the row; left_columns, a struct of its values of `columns`; left_lines, an array as long as lines of
    (text, after), where a null text is a dropped line and `after` a line inserted behind it; left_added, the text of a row that it adds
    under the id -1-id with the base's columns, or null.
    """
    now = lambda b, c: F.col(f"{b}_columns.{c}")
    dropped = {b: F.col(f"{b}_dropped") for b in (left, right)}
    whole = dropped[left] | dropped[right]

    def state(x: Column, i: Column) -> Column:
        a, b = F.get(f"{left}_lines", i), F.get(f"{right}_lines", i)
        kinds = kind_of(x, a["text"], b["text"]).alias("line"), kind_of_gap(a["after"], b["after"]).alias("gap")
        return F.struct(F.array(winner(x, a["text"], b["text"]), F.coalesce(b["after"], a["after"])).alias("out"), *kinds)

    def changed(b: str) -> Column:
        of_lines = F.exists(F.arrays_zip(F.col(lines).alias("x"), F.col(f"{b}_lines").alias("y")), lambda u: ~u["x"].eqNullSafe(u["y"]["text"]) | u["y"]["after"].isNotNull())
        return functools.reduce(Column.__or__, (~now(b, c).eqNullSafe(F.col(c)) for c in columns), of_lines)

    fight = (dropped[left] & ~dropped[right] & changed(right)) | (dropped[right] & ~dropped[left] & changed(left))
    out = rows.withColumns({"_states": F.when(~whole, F.transform(lines, state)), "_fight": F.when(whole, fight)})
    of_columns = _counts([kind_of(F.col(c), now(left, c), now(right, c)) for c in columns])
    of_lines = F.aggregate("_states", of_columns, lambda sums, s: _counts([s["line"], s["gap"]], sums))
    of_row = _counts([F.when(F.col("_fight"), F.lit(EDIT_DELETE)).otherwise(F.lit(CLEAN))])
    out = out.withColumns({"_counts": F.when(whole, of_row).otherwise(of_lines), "_stays": ~whole | (F.col("_fight") & ~dropped[right])})
    strings = lambda parts: F.array_compact(F.flatten(parts))
    theirs = strings(F.transform(f"{right}_lines", lambda u: F.array(u["text"], u["after"])))
    kept = out.select(
        F.col(id_column),
        *(F.when(F.col("_stays"), F.when(whole, now(right, c)).otherwise(winner(F.col(c), now(left, c), now(right, c)))).alias(c) for c in columns),
        F.when(F.col("_stays"), F.when(whole, theirs).otherwise(strings(F.transform("_states", lambda s: s["out"])))).alias(lines),
        *(F.col(f"_counts.{c}").alias(c) for c in COUNTS),
    )
    # the added rows read no line of the base
    pair = F.col(f"{left}_added"), F.col(f"{right}_added")
    more = rows.filter(pair[0].isNotNull() | pair[1].isNotNull()).select(id_column, *columns, F.coalesce(*reversed(pair)).alias("_text"), _counts([kind_of_gap(*pair)]).alias("_counts"))
    added = more.select((F.lit(-1).cast("long") - F.col(id_column)).alias(id_column), *columns, F.split("_text", "\n").alias(lines), *(F.col(f"_counts.{c}").alias(c) for c in COUNTS))
    return kept.unionByName(added)


def coded(rows: DataFrame, branch: str, name: str, id_column: str, columns: Sequence[str], lines: str = "lines") -> DataFrame:
    """Adds the columns of a branch as merge() takes them, by the code crc32(name:id:unit) modulo 7 of each unit.

    Row, columns, and lines 0, 1, ...: 0 drops (columns: empties), 1 and 2 append ! or ? to columns and lines, 3 and 4 insert the line ! or ?
    after a line, or add a row with that text.
    """
    prefix = F.concat(F.lit(f"{name}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"))
    rows = rows.withColumn("_prefix", prefix)
    code = lambda unit: F.crc32(F.concat(F.col("_prefix"), unit)) % 7
    edited = lambda value, c, gone: F.when(c == 0, gone).when(c == 1, F.concat(value, F.lit("!"))).when(c == 2, F.concat(value, F.lit("?"))).otherwise(value)
    inserted = lambda c: F.when(c == 3, F.lit("!")).when(c == 4, F.lit("?"))
    # codes come first, so that each is worked out once
    rows = rows.withColumns({"_row": code(F.lit("row")), "_of": F.struct(*(code(F.lit(c)).alias(c) for c in columns)), "_codes": F.transform(lines, lambda x, i: code(i.cast("string")))})

    def line(x: Column, i: Column) -> Column:
        c = F.get("_codes", i)
        return F.struct(edited(x, c, F.lit(None).cast("string")).alias("text"), inserted(c).alias("after"))

    return rows.withColumns({
        f"{branch}_dropped": F.col("_row") == 0,
        f"{branch}_columns": F.struct(*(edited(F.col(c), F.col(f"_of.{c}"), F.lit("")).alias(c) for c in columns)),
        f"{branch}_lines": F.transform(lines, line),
        f"{branch}_added": inserted(F.col("_row")),
    }).drop("_prefix", "_row", "_of", "_codes")


def merged_documents(docs: DataFrame) -> DataFrame:
    """merge() of the coded branches L and R of documents."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("lang").alias("lang"), filled("source").alias("source"), F.split(filled("text"), "\n").alias("lines"))
    columns = ["lang", "source"]
    return merge(coded(coded(rows, "left", "L", "doc_id", columns), "right", "R", "doc_id", columns), "doc_id", columns)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text_sha256, counters) of merged_documents()."""
    merged = merged_documents(docs)
    return merged.select("doc_id", "lang", "source", F.sha2(F.array_join("lines", "\n"), 256).alias("text_sha256"), *COUNTS)
