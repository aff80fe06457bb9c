"""Functions on nested arrays and polygons; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flattened(values: Column, depth: int = 1) -> Column:
    """`depth` levels of nesting removed."""
    for _ in range(depth):
        values = F.flatten(values)
    return values


def deep_sorted(values: Column) -> Column:
    """Inner arrays sorted, then the outer by their first elements."""
    return F.array_sort(F.transform(values, lambda v: F.array_sort(v)))


def unzipped(rows: Column, *fields: str) -> Column:
    """An array of structs as a struct of arrays."""
    side = lambda f: F.transform(rows, lambda r: r[f])
    return F.struct(*(side(f).alias(f) for f in fields))


def padded(values: Column, width: Column | int, fill: Column | int | float = 0) -> Column:
    """An array filled up to a width."""
    width = F.lit(width) if isinstance(width, int) else width
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    return F.concat(values, F.array_repeat(fill, F.greatest(width - F.size(values), F.lit(0))))


def one_hot(codes: Column, size: int) -> Column:
    """A row of zeros and a one for each code."""
    return F.transform(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == c, 1).otherwise(0)))


def points(text: Column) -> Column:
    """'x,y x,y' as [[x, y], ...]."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.transform(F.split(p, ","), lambda v: v.cast("int")))


def point_text(coords: Column) -> Column:
    """[[x, y], ...] as 'x,y x,y'."""
    return F.array_join(F.transform(coords, lambda p: F.concat_ws(",", p[0], p[1])), " ")


def box(coords: Column) -> Column:
    """(l, t, r, b) of a polygon."""
    x, y = F.transform(coords, lambda p: p[0]), F.transform(coords, lambda p: p[1])
    return F.struct(F.array_min(x).alias("l"), F.array_min(y).alias("t"), F.array_max(x).alias("r"), F.array_max(y).alias("b"))


def corner_box(coords: Column) -> Column:
    """(l, t, r, b) from the first and the third corner of a rectangle."""
    return F.struct(coords[0][0].alias("l"), coords[0][1].alias("t"), coords[2][0].alias("r"), coords[2][1].alias("b"))


def box_points(b: Column) -> Column:
    """The four corners of a box."""
    return F.array(F.array(b["l"], b["t"]), F.array(b["r"], b["t"]), F.array(b["r"], b["b"]), F.array(b["l"], b["b"]))


def shifted(coords: Column, left: Column, top: Column) -> Column:
    """Coordinates in the frame of (left, top)."""
    return F.transform(coords, lambda p: F.array(p[0] - left, p[1] - top))


def inside(coords: Column, b: Column) -> Column:
    """Do all points lie in the box, borders included?"""
    return F.forall(coords, lambda p: p[0].between(b["l"], b["r"]) & p[1].between(b["t"], b["b"]))


def has_area(b: Column) -> Column:
    return (b["l"] != b["r"]) & (b["t"] != b["b"])


def by_class(boxes: Column, classes: Column, names: Column) -> Column:
    """Boxes with their class numbers and names, as an array of structs."""
    return F.transform(F.arrays_zip(boxes.alias("box"), classes.alias("cls")), lambda x: F.struct(x["box"].alias("box"), x["cls"].alias("cls"), F.get(names, x["cls"]).alias("name")))


def has_classes(classes: Column, names: Column, wanted: list[str]) -> Column:
    """For each wanted name: does a box of that class occur?  Null if the name is unknown."""
    found = F.transform(classes, lambda c: F.get(names, c))
    return F.array(*(F.when(F.array_contains(names, w), F.array_contains(found, w)) for w in wanted))
