"""Pages, regions and lines: flat tables, nested documents, and moves between them.

Order is data here: lines and regions carry their places, and every regrouping sorts by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import nested
from vellum.functions.text import blank


def regions(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, region_pos, region_id, coords, l, t, r, b) of page documents."""
    rows = pages.select(key, F.posexplode("regions").alias("region_pos", "x")).select(key, "region_pos", F.col("x.id").alias("region_id"), F.col("x.coords").alias("coords"))
    return rows.withColumn("_b", nested.box(F.col("coords"))).select("*", "_b.*").drop("_b")


def lines(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, line_pos, line_id, region_ids, ...) of page documents, whether lines stand at the top or in regions."""
    inner = F.flatten(F.transform(F.coalesce("regions", F.array().cast(pages.schema["regions"].dataType)), lambda r: F.coalesce(F.transform(r["lines"], lambda x: x.withField("regions", F.coalesce(x["regions"], F.array(r["id"])))), F.array().cast(pages.schema["lines"].dataType))))
    found = F.when(F.size(F.coalesce("lines", F.array().cast(pages.schema["lines"].dataType))) > 0, F.col("lines")).otherwise(inner)
    rows = pages.select(key, F.posexplode(found).alias("line_pos", "x"))
    return rows.select(key, "line_pos", F.col("x.id").alias("line_id"), F.col("x.regions").alias("region_ids"), "x.coords", "x.baseline", "x.centerline", F.col("x.x-height").alias("x_height"), "x.text", "x.custom")


def polygons(found: DataFrame, polygon: str = "coords", key: str = "page_id") -> DataFrame:
    return found.select(key, "line_pos", F.col(polygon).alias("polygon"))


def usable(found: DataFrame, with_text: bool = False) -> DataFrame:
    """Lines with a baseline and a polygon, and with a text if that is asked for."""
    rows = found.filter(F.col("baseline").isNotNull() & F.col("coords").isNotNull())
    return rows.filter(~blank(F.col("text"))) if with_text else rows


def sink(found: DataFrame, key: str = "page_id", region: Column | None = None) -> DataFrame:
    """(page_id, region_id, lines): lines under their regions (the outermost by default), in their order."""
    region = F.col("region_ids")[0] if region is None else region
    others = [c for c in found.columns if c not in (key, "line_pos")]
    return found.groupBy(key, region.alias("region_id")).agg(F.sort_array(F.collect_list(F.struct("line_pos", *others))).alias("lines"))


def lift(sunk: DataFrame, key: str = "page_id") -> DataFrame:
    """The inverse of sink()."""
    return sunk.select(key, F.explode("lines").alias("x")).select(key, "x.*")


def without_empty(found_regions: DataFrame, found_lines: DataFrame, key: str = "page_id") -> DataFrame:
    """Regions that own a line."""
    owned = found_lines.select(key, F.col("region_ids")[0].alias("region_id"))
    return found_regions.join(owned, [key, "region_id"], "left_semi")


def in_region(found_lines: DataFrame, found_regions: DataFrame, key: str = "page_id") -> DataFrame:
    """Lines with polygons and baselines in the frame of their outermost region."""
    own = found_regions.select(key, "region_id", "l", "t", "r", "b")
    rows = found_lines.withColumn("region_id", F.col("region_ids")[0]).join(own, [key, "region_id"])
    return rows.withColumn("coords", nested.shifted(F.col("coords"), F.col("l"), F.col("t"))).withColumn("baseline", nested.shifted(F.col("baseline"), F.col("l"), F.col("t")))


def extended(found_regions: DataFrame, found_lines: DataFrame, key: str = "page_id") -> DataFrame:
    """Region boxes grown to hold the boxes of their lines."""
    b = found_lines.withColumn("region_id", F.col("region_ids")[0]).withColumn("_b", nested.box(F.col("coords")))
    most = b.groupBy(key, "region_id").agg(F.min("_b.l").alias("_l"), F.min("_b.t").alias("_t"), F.max("_b.r").alias("_r"), F.max("_b.b").alias("_bb"))
    rows = found_regions.join(most, [key, "region_id"], "left")
    return rows.withColumn("l", F.least("l", "_l")).withColumn("t", F.least("t", "_t")).withColumn("r", F.greatest("r", "_r")).withColumn("b", F.greatest("b", "_bb")).drop("_l", "_t", "_r", "_bb")


#: Outer boxes of a page from which it is divided into cells.
CROWDED = 64


def _level(size: Column) -> Column:
    """The exponent of the smallest power of two that is not below a size, -20 at least."""
    return F.greatest(F.ceil(F.log2(F.greatest(size.cast("double"), F.lit(2.0**-20)))), F.lit(-20)).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(2.0), level)).cast("long")


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("page_id",), crowded: int = CROWDED) -> DataFrame:
    """Inner boxes (l, t, r, b) with each outer box (ol, ot, or_, ob) of the same page that holds them, borders included.

    Pages of few outer boxes are joined by their key.  On the others, an outer box lies in the two or so cells a side of a grid as wide and as
    high as itself, rounded up to powers of two, and an inner box looks up the one cell of its top left corner in each grid of that table that is no finer than itself: each pair is
    found once, and boxes far apart never meet.  Null places, and boxes that end before they begin, hold nothing and are held by nothing.
    """
    keys = list(keys)
    inner = inner.filter((F.col("l") <= F.col("r")) & (F.col("t") <= F.col("b")))
    outer = outer.filter((F.col("ol") <= F.col("or_")) & (F.col("ot") <= F.col("ob")))
    holds = (F.col("l") >= F.col("ol")) & (F.col("t") >= F.col("ot")) & (F.col("r") <= F.col("or_")) & (F.col("b") <= F.col("ob"))
    full = outer.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).select(*keys)
    few = inner.join(outer.join(full, keys, "left_anti"), keys).filter(holds)
    many = outer.join(full, keys, "left_semi").withColumns({"_w": _level(F.col("or_") - F.col("ol")), "_h": _level(F.col("ob") - F.col("ot"))})
    side = lambda lo, hi, level: F.sequence(_cell(F.col(lo), F.col(level)), _cell(F.col(hi), F.col(level)))
    spread = many.withColumn("_x", F.explode(side("ol", "or_", "_w"))).withColumn("_y", F.explode(side("ot", "ob", "_h")))
    # the grids in use, a few hundred at most: sizes come in powers of two
    grids = many.agg(F.collect_set(F.struct("_w", "_h"))).scalar()
    asked = inner.join(full, keys, "left_semi").withColumns({"_w0": _level(F.col("r") - F.col("l")), "_h0": _level(F.col("b") - F.col("t")), "_grids": grids})
    asked = asked.withColumn("_g", F.explode(F.filter("_grids", lambda g: (g["_w"] >= F.col("_w0")) & (g["_h"] >= F.col("_h0"))))).select(*inner.columns, "_g._w", "_g._h")
    asked = asked.withColumns({"_x": _cell(F.col("l"), F.col("_w")), "_y": _cell(F.col("t"), F.col("_h"))})
    met = asked.join(spread, [*keys, "_w", "_h", "_x", "_y"]).filter(holds).drop("_w", "_h", "_x", "_y")
    return few.unionByName(met)


def in_grid(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes with the cell (col, row) of a regular grid that holds all of them: computed, not joined."""
    col, row = F.floor(F.col("l") / width), F.floor(F.col("t") / height)
    return boxes.withColumn("col", col).withColumn("row", row).filter((F.col("r") <= (col + 1) * width) & (F.col("b") <= (row + 1) * height))


def injected(target: DataFrame, source: DataFrame, keys: Sequence[str], field: str = "text", force: bool = False, id_column: str = "line_id") -> DataFrame:
    """target with `field` from source where source has it, by place.  Both must have the same places, and the same ids unless forced."""
    mine = target.withColumn("_a", F.lit(True)).withColumnRenamed(field, "_old")
    other = source.select(*keys, F.col(field).alias("_new"), F.col(id_column).alias("_id"), F.lit(True).alias("_b"))
    both = mine.join(other, list(keys), "full")
    uneven = F.col("_a").isNull() | F.col("_b").isNull()
    named = F.lit(False) if force else ~F.col(id_column).eqNullSafe(F.col("_id"))
    checked = F.when(uneven, F.raise_error(F.lit("layouts have different numbers of lines"))).when(named, F.raise_error(F.lit("lines at the same place have different ids"))).otherwise(True)
    return both.filter(checked).withColumn(field, F.coalesce("_new", "_old")).drop("_old", "_new", "_id", "_a", "_b")


def with_predictions(found: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("page_id", "line_id")) -> DataFrame:
    """Lines with their predicted text (if any) as text, and their own text as gt."""
    return found.withColumnRenamed("text", "gt").join(predictions.select(*keys, F.col("prediction").alias("text"), *(["scores"] if "scores" in predictions.columns else [])), list(keys), "left")


def without_text(found: DataFrame) -> DataFrame:
    return found.withColumn("text", F.lit(None).cast("string"))


def commented(pages: DataFrame, comment: str, created: str | None = None) -> DataFrame:
    """Page documents with a comment, and a date if given, in their metadata."""
    meta = F.col("metadata").withField("comments", F.lit(comment))
    meta = F.when(F.col("metadata").isNull(), F.struct(F.lit(created).cast("string").alias("created"), F.lit(None).cast("string").alias("creator"), F.lit(comment).alias("comments"))).otherwise(meta.withField("created", F.lit(created)) if created else meta)
    return pages.withColumn("metadata", meta)


def crops(found: DataFrame, labels: Sequence[str], key: str = "page_id") -> DataFrame:
    """(page_id, pos, name, box) of a layout application's boxes whose class is among the labels."""
    rows = found.select(key, F.posexplode(nested.by_class(F.col("rect_LTRB"), F.col("rect_classes"), F.col("class_names"))).alias("pos", "x"))
    return rows.filter(F.col("x.name").isin(list(labels))).select(key, "pos", F.col("x.name").alias("name"), F.col("x.box").alias("box"))


def sample_name(stem: Column, region: Column | None = None, line: Column | None = None, iteration: Column | None = None) -> Column:
    """`stem-region`, `stem-region-l<line>`, `...-i<iteration>`."""
    parts = [stem]
    if region is not None:
        parts.append(F.concat(F.lit("-"), region))
    if line is not None:
        parts.append(F.concat(F.lit("-l"), line.cast("string")))
    if iteration is not None:
        parts.append(F.concat(F.lit("-i"), iteration.cast("string")))
    return F.concat(*parts)


def by_size(pages: DataFrame, most_pixels: int, width: str = "image_width", height: str = "image_height", key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(pages of at most so many pixels, log of the others with their pixels); an unknown size counts as small enough."""
    pixels = F.coalesce(F.col(width).cast("long") * F.col(height), F.lit(0))
    return pages.filter(pixels <= most_pixels), pages.filter(pixels > most_pixels).select(key, pixels.alias("pixels"), F.lit("too large").alias("reason"))


def region_documents(pages: DataFrame, found_regions: DataFrame, found_lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, region_id, l, t, r, b, json): for each outermost region that owns a line its box, and its lines in its frame as a document.

    Crops of the same box give the images that go with the documents.
    """
    boxes = found_regions.filter(F.size("parent_ids") == 0).withColumn("_b", nested.box(F.col("coords"))).select(key, "region_id", "_b.*")
    rows = in_region(found_lines, boxes, key)
    line = F.struct("line_pos", F.col("line_id").alias("id"), "coords", "baseline", "text")
    body = F.struct(F.concat_ws("-", F.col(key), F.col("region_id")).alias("image_filename"), (F.col("r") - F.col("l") + 1).alias("image_width"), (F.col("b") - F.col("t") + 1).alias("image_height"), F.col("_lines").alias("lines"))
    grouped = rows.groupBy(key, "region_id", "l", "t", "r", "b").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    return grouped.select(key, "region_id", "l", "t", "r", "b", F.to_json(body).alias("json"))
