"""Polygon masks, crops, paddings and channels of images, in Arrow functions over numpy.

Operators on images take columns by name and give a column; null where an argument is null.  Where one follows another, their step() goes into together().

An image is a struct (height, width, channels, data) with rows of uint8 samples in data; a mask has one channel.
A pixel belongs to a polygon if its centre does (even-odd rule), its left and top borders included.  mask() and mask_sum() give images of whole
pages; mask_tiles(), page_cover() and area() work on scan-line spans, for pages of any size.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.functions.batches import slices

IMAGE = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("data", T.BinaryType())])


def array_of(image) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["channels"])


def image_of(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a if a.ndim == 3 else a[:, :, None], np.uint8)
    return {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": a.tobytes()}


def polygon_mask(points, height: int, width: int) -> np.ndarray:
    """Boolean (height, width): along each row of centres, inside changes at every edge crossed."""
    p = np.array([list(q) for q in points], float).tolist()
    out = np.zeros((height, width), bool)
    if len(p) < 3:
        return out
    y = np.arange(height) + 0.5
    x = np.arange(width) + 0.5
    for (x0, y0), (x1, y1) in zip(p, [*p[1:], p[0]], strict=True):
        if y0 == y1:
            continue
        rows = np.flatnonzero((y >= min(y0, y1)) & (y < max(y0, y1)))
        cross = x0 + (y[rows] - y0) * (x1 - x0) / (y1 - y0)
        out[rows] ^= x[None, :] >= cross[:, None]
    return out


def polygon_spans(points, top: int, bottom: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, lo, hi) of the pixels lo to hi - 1 of polygon_mask() in the rows from top to bottom - 1, in order."""
    p = np.array([list(q) for q in points], float).reshape(-1, 2)
    return _spans(p[:, 0], p[:, 1], np.array([0, len(p)]), *(np.array([v]) for v in (top, bottom, width)))[1:]


def _spans(x, y, at, top, bottom, width) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, y, lo, hi) of many polygons: what their edges cross is sorted along each row.  x, y: all points; at: where polygons begin and end."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    after = np.arange(1, len(x) + 1)
    after[at[1:][np.diff(at) > 0] - 1] = at[:-1][np.diff(at) > 0]
    some = np.flatnonzero((y != y[after]) & (np.diff(at)[of] > 2))
    of, x0, y0, x1, y1 = of[some], x[some], y[some], x[after[some]], y[after[some]]
    first = np.maximum(np.ceil(np.minimum(y0, y1) - 0.5), top[of]).astype(np.int64)
    n = np.maximum(np.minimum(np.ceil(np.maximum(y0, y1) - 0.5), bottom[of]).astype(np.int64) - first, 0)
    edge = np.repeat(np.arange(len(n)), n)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    cross = x0[edge] + (row + 0.5 - y0[edge]) * (x1[edge] - x0[edge]) / (y1[edge] - y0[edge])
    order = np.lexsort((cross, row, of[edge]))
    of, row, cross = of[edge][order], row[order], cross[order]
    left = np.ceil(cross - 0.5)  # the first pixel whose centre is not left of the crossing
    left += (left + 0.5 < cross).astype(float) - (left - 0.5 >= cross).astype(float)
    left = np.clip(left, 0, width[of]).astype(np.int64)
    lo, hi = left[::2], left[1::2]
    on = lo < hi
    return of[::2][on], row[::2][on], lo[on], hi[on]


SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("y", "lo", "hi")]))
#: Rows of polygons that are scanned together.
SCANNED = 1 << 20


def _structs(at: np.ndarray, valid: np.ndarray | None, **fields: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values, mask=None if valid is None else pa.array(~valid))


@F.arrow_udf(SPANS)
def spans(points: pa.Array, top: pa.Array, bottom: pa.Array, width: pa.Array) -> pa.Array:
    """polygon_spans() of polygons; null where an argument is null.  A polygon takes memory for its rows, not for its page."""
    valid = np.logical_and.reduce([c.is_valid().to_numpy(False) for c in (points, top, bottom, width)])
    low, high, wide = (c.fill_null(0).to_numpy(False).astype(np.int64) for c in (top, bottom, width))
    size = np.where(valid, points.value_lengths().fill_null(0).to_numpy(False), 0).astype(np.int64)
    at = np.append(0, np.cumsum(size))
    pair = points.filter(pa.array(valid)).flatten()
    first = pair.offsets.to_numpy(False)[: len(pair)]
    values = pair.values.to_numpy(False).astype(float)
    x, y = values[first], values[first + 1]
    work = np.cumsum(np.maximum(high - low, 1))
    parts, lo = [np.zeros((4, 0), np.int64)], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + SCANNED)))
        found = _spans(x[at[lo] : at[hi]], y[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], low[lo:hi], high[lo:hi], wide[lo:hi])
        parts.append(np.stack([found[0] + lo, *found[1:]]))
        lo = hi
    of, row, left, right = np.concatenate(parts, axis=1)
    begin = np.append(0, np.cumsum(np.bincount(of, minlength=len(size))))
    return _structs(begin, valid, y=row.astype(np.int32), lo=left.astype(np.int32), hi=right.astype(np.int32))


@F.arrow_udf(T.ArrayType(T.StructType([*SPANS.elementType.fields, T.StructField("n", T.LongType())])))
def _summed(steps: pa.Array) -> pa.Array:
    """Runs of equal sums from sorted steps (y, x, n), which end each row at 0."""
    y, x, n = (f.to_numpy(False) for f in steps.flatten().flatten())
    total = np.cumsum(n)
    on = total != 0
    begin = np.append(0, np.cumsum(steps.value_lengths().to_numpy(False)))
    return _structs(np.append(0, np.cumsum(on))[begin], None, y=y[on], lo=x[on], hi=np.append(x[1:], 0)[on].astype(np.int32), n=total[on])


def area(points: Column, height: Column, width: Column) -> Column:
    """Pixels of a polygon's mask, without the mask."""
    return F.aggregate(spans(points, F.lit(0), height, width), F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])


def mask_tiles(found: DataFrame, keys: Sequence[str], polygon: str, height: Column | int, width: Column | int, tile: int = 256) -> DataFrame:
    """(keys..., tile_row, tile_col, runs): of each square tile of a page that a polygon touches, how many polygons hold each pixel.

    runs: array of (y, lo, hi, n), in places of the page, in order, where n is not 0.  A polygon is cut into bands of a tile's height before it is scanned, and where spans
    begin and end is added up by pixel, so that neither a page nor a crowd of polygons is held anywhere: a tile has tile * tile such places at most.
    """
    t = F.lit(tile)
    y = F.transform(polygon, lambda p: p[1])
    low, high = F.greatest(F.floor(F.array_min(y)), F.lit(0)), F.least(F.ceil(F.array_max(y)), F.lit(height))
    bands = found.withColumns({"_low": low.cast("long"), "_high": high.cast("long"), "_width": F.lit(width).cast("int")}).filter("_low < _high")
    bands = bands.withColumn("tile_row", F.explode(F.sequence((F.col("_low") / t).cast("long"), ((F.col("_high") - 1) / t).cast("long"))))
    ends = F.least((F.col("tile_row") + 1) * t, F.col("_high"))
    rows = bands.select(*keys, "tile_row", F.explode(spans(F.col(polygon), (F.col("tile_row") * t).cast("int"), ends.cast("int"), F.col("_width"))).alias("s"))
    rows = rows.withColumn("tile_col", F.explode(F.sequence((F.col("s.lo") / t).cast("long"), ((F.col("s.hi") - 1) / t).cast("long"))))
    lo, hi = F.greatest("s.lo", (F.col("tile_col") * t).cast("int")), F.least("s.hi", ((F.col("tile_col") + 1) * t).cast("int"))
    step = lambda x, n: F.struct(x.alias("x"), F.lit(n).cast("long").alias("n"))
    steps = rows.select(*keys, "tile_row", "tile_col", "s.y", F.explode(F.array(step(lo, 1), step(hi, -1))).alias("e"))
    steps = steps.groupBy(*keys, "tile_row", "tile_col", "y", "e.x").agg(F.sum("e.n").alias("n")).filter("n <> 0")
    each = steps.groupBy(*keys, "tile_row", "tile_col").agg(F.sort_array(F.collect_list(F.struct("y", "x", "n"))).alias("e"))
    return each.select(*keys, "tile_row", "tile_col", _summed("e").alias("runs"))


#: Scanned rows and points of a page's polygons up to which page_cover() sums the page in one row.
WHOLE = 1 << 11


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("covered", "total", "most")]))
def _covered(polygons: pa.Array) -> pa.Array:
    """What page_cover() gives of each page, from lists of its polygons (low, high, width, flat points)."""
    sizes = lambda lists: np.append(0, np.cumsum(lists.value_lengths().to_numpy(False), dtype=np.int64))
    count = sizes(polygons)
    low, high, width, flat = polygons.flatten().flatten()
    low, high, width = (v.to_numpy(False).astype(np.int64) for v in (low, high, width))
    at = sizes(flat) // 2
    values = flat.flatten().to_numpy(False).astype(float)
    page = np.repeat(np.arange(len(polygons)), np.diff(count))
    work = np.append(0, np.cumsum(high - low))[count]
    out, lo = np.zeros((3, len(polygons)), np.int64), 0
    while lo < len(polygons):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + SCANNED, "right")) - 1)
        a, b = count[lo], count[hi]
        points = values[2 * at[a] : 2 * at[b]]
        of, y, left, right = _spans(points[::2], points[1::2], at[a : b + 1] - at[a], low[a:b], high[a:b], width[a:b])
        of = np.tile(page[a:b][of], 2)
        y, x, n = np.tile(y, 2), np.append(left, right), np.repeat([1, -1], len(left))
        order = np.lexsort((x, y, of))
        of, y, x, n = of[order], y[order], x[order], np.cumsum(n[order])
        on = np.flatnonzero(n[:-1] * np.diff(x))  # every row of a page ends at 0
        of, size, n = of[on], x[on + 1] - x[on], n[on]
        np.add.at(out[0], of, size), np.add.at(out[1], of, size * n), np.maximum.at(out[2], of, n)
        lo = hi
    return pa.StructArray.from_arrays([pa.array(v) for v in out], ["covered", "total", "most"])


def page_cover(found: DataFrame, keys: Sequence[str], polygon: str, height: Column | int, width: Column | int, tile: int = 256) -> DataFrame:
    """(keys..., covered, total, most): pixels of a page in any polygon, the sum over all, and the most polygons that hold one pixel.

    The polygons of a page with little to scan (WHOLE) travel as they are and are summed in one row; larger pages go by mask_tiles().  What they have to scan is
    counted first; the large ones are fewer than a WHOLE-th of all that is scanned, so their keys are broadcast.
    """
    y = F.transform(polygon, lambda p: p[1])
    low, high = F.greatest(F.floor(F.array_min(y)), F.lit(0)), F.least(F.ceil(F.array_max(y)), F.lit(height))
    some = (low < high) & (F.size(polygon) > 2)
    work = F.when(some, (high - low).cast("long") + F.size(polygon))
    large = found.groupBy(*keys).agg(F.sum(work).alias("_work")).filter(F.col("_work") > WHOLE).select(*(F.col(f"`{k}`").alias(f"_of_{k}") for k in keys))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`"))
    runs = mask_tiles(found.join(F.broadcast(large), on, "left_semi"), keys, polygon, height, width, tile).select(*keys, F.explode("runs").alias("r"))
    size = (F.col("r.hi") - F.col("r.lo")).cast("long")
    tiled = runs.groupBy(*keys).agg(F.sum(size).alias("covered"), F.sum(size * F.col("r.n")).alias("total"), F.max("r.n").alias("most"))
    flat = F.flatten(F.transform(polygon, lambda p: F.slice(p, 1, 2)))
    each = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(width).cast("int").alias("width"), flat.alias("flat"))
    rest = found.join(F.broadcast(large), on, "left_anti").filter(some)
    whole = rest.groupBy(*keys).agg(F.collect_list(each).alias("_polygons")).select(*keys, _covered("_polygons").alias("_c"))
    return tiled.unionByName(whole.select(*keys, "_c.*").filter("covered > 0"))


class Step:
    """An operator with what it is given, columns or earlier steps, until together() makes columns."""

    def __init__(self, f: Callable, kind: T.DataType, given: dict[str, Column | Step]):
        self.f, self.kind, self.given = f, kind, given


def together(**steps: Step) -> Column:
    """A struct of what the steps give, row by row in one function: images that one step takes from another are no columns, and those not given back are held for one row only.

    Operators that take each other's columns need a Python process each in every task, with a batch of all images between them.
    """
    order: list[Step] = []
    columns: list[Column] = []

    def place(step: Step) -> None:
        if step not in order:
            for v in step.given.values():
                place(v) if isinstance(v, Step) else columns.append(v)
            order.append(step)

    for s in steps.values():
        place(s)
    names = {id(c): f"c{k}" for k, c in enumerate(columns)}
    calls = [(s.f, {k: order.index(v) if isinstance(v, Step) else names[id(v)] for k, v in s.given.items()}) for s in order]
    ends = {k: order.index(s) for k, s in steps.items()}
    kind = T.StructType([T.StructField(k, s.kind) for k, s in steps.items()])
    made = to_arrow_type(kind)

    def row(r: dict) -> dict:
        found = []
        for f, given in calls:
            values = {k: r[v] if isinstance(v, str) else found[v] for k, v in given.items()}
            found.append(None if any(v is None for v in values.values()) else f(**values))
        return {k: found[v] for k, v in ends.items()}

    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        parts = [pa.array([row(r) for r in some.to_pylist()], made) for some in slices(rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    return run(F.struct(*(c.alias(names[id(c)]) for c in {id(c): c for c in columns}.values())))


def _operator(kind: T.DataType):
    """A function of one row's values as an operator on columns; its step() takes steps, too."""

    def wrap(f: Callable):
        step = lambda *a, **given: Step(f, kind, inspect.signature(f).bind(*a, **given).arguments)
        run = lambda *a, **given: together(out=step(*a, **given))["out"]
        run.step, run.__name__, run.__doc__ = step, f.__name__, f.__doc__
        return run

    return wrap


@_operator(IMAGE)
def mask(points, height, width):
    """One channel, 255 inside the polygon: mask(points=..., height=..., width=...)."""
    return image_of(polygon_mask(points, height, width) * 255)


@_operator(IMAGE)
def tile_image(runs, row, col, tile):
    """One channel of a tile of mask_tiles(): how many polygons hold each pixel, 255 at most."""
    out = np.zeros((tile, tile), np.uint8)
    for r in runs:
        out[r["y"] - row * tile, r["lo"] - col * tile : r["hi"] - col * tile] = min(r["n"], 255)
    return image_of(out)


@_operator(IMAGE)
def mask_sum(polygons, height, width):
    """One channel: how many of the polygons hold each pixel."""
    total = np.zeros((height, width), np.int64)
    for p in polygons:
        total += polygon_mask(p, height, width)
    return image_of(np.minimum(total, 255))


@_operator(IMAGE)
def crop(image, l, t, r, b):  # noqa: E741
    """Pixels of the box, right and bottom borders included, cut to the image."""
    return image_of(array_of(image)[max(t, 0) : b + 1, max(l, 0) : r + 1])


@_operator(IMAGE)
def zero_pad(image, inside):
    """The image where the mask is set, 0 elsewhere."""
    return image_of(array_of(image) * (array_of(inside) > 0))


@_operator(IMAGE)
def median_pad(image, inside):
    """The image where the mask is set, each channel's median there elsewhere; an empty mask counts as 0."""
    a, m = array_of(image), array_of(inside)[:, :, 0] > 0
    fill = np.median(a[m], axis=0).astype(np.uint8) if m.any() else np.zeros(a.shape[2], np.uint8)
    return image_of(np.where(m[:, :, None], a, fill))


@_operator(IMAGE)
def noise_pad(image, inside, seed):
    """The image where the mask is set, noise from the seed elsewhere."""
    a, m = array_of(image), array_of(inside) > 0
    return image_of(np.where(m, a, np.random.default_rng(seed).integers(0, 255, a.shape, dtype=np.uint8)))


@_operator(IMAGE)
def alpha_channel(inside, transparency):
    """255 where the mask is set, 255 * transparency elsewhere."""
    return image_of(np.where(array_of(inside) > 0, 255, int(255 * transparency)))


def _gray(a: np.ndarray) -> np.ndarray:
    #: fixed values: luminance weights of red, green and blue
    return a[:, :, 0].astype(float) if a.shape[2] == 1 else a[:, :, :3] @ np.array([0.2125, 0.7154, 0.0721])


@_operator(IMAGE)
def gray_channel(image):
    return image_of(np.rint(_gray(array_of(image))))


@_operator(IMAGE)
def blurry_channel(image, size):
    """Mean of the gray values in a square of `size` around each pixel, as far as it lies in the image."""
    g = np.rint(_gray(array_of(image)))
    h, w = g.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = g.cumsum(0).cumsum(1)
    lo, hi = size // 2, size - size // 2
    y0, y1 = np.maximum(np.arange(h) - lo, 0), np.minimum(np.arange(h) + hi, h)
    x0, x1 = np.maximum(np.arange(w) - lo, 0), np.minimum(np.arange(w) + hi, w)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return image_of(total // ((y1 - y0)[:, None] * (x1 - x0)[None, :]))


@_operator(IMAGE)
def with_channel(image, channel):
    """The image with one more channel."""
    return image_of(np.concatenate([array_of(image), array_of(channel)[:, :, :1]], axis=2))


def target_size(height: Column, width: Column, to_height: int, most_width: int) -> Column:
    """(height, width) after resizing to a height, squeezed where wider than most_width."""
    wide = F.floor(width * F.lit(to_height) / height).cast("int")
    return F.struct(F.lit(to_height).alias("height"), F.least(wide, F.lit(most_width)).alias("width"))


@_operator(IMAGE)
def resized(image, height, width):
    """Area-weighted means: each new pixel averages the part of the old image that it covers (linear between pixels if larger)."""
    a = array_of(image).astype(float)
    for axis, n in ((0, height), (1, width)):
        a = _resample(a, n, axis)
    return image_of(np.rint(a))


def _resample(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    old = a.shape[axis]
    scale = max(1.0, old / n)
    centre = (np.arange(n) + 0.5) * old / n - 0.5
    weight = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] - centre[:, None]) / scale)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.moveaxis(np.tensordot(weight, a, (1, axis)), 0, axis)


@_operator(IMAGE)
def padded(image, width):
    """Zeros to the right up to a width; wider images stay as they are."""
    a = array_of(image)
    return image_of(np.pad(a, ((0, 0), (0, max(0, width - a.shape[1])), (0, 0))))


@_operator(IMAGE)
def padding_mask(image, width):
    """One channel: 255 where padded() keeps the image."""
    a = array_of(image)
    out = np.zeros((a.shape[0], max(width, a.shape[1])), np.uint8)
    out[:, : a.shape[1]] = 255
    return image_of(out)


def mask_box(points: Column) -> Column:
    """Box of a polygon's mask: (l, t, r, b) with the last pixel inside."""
    from vellum.functions.nested import box

    b = box(points)
    return F.struct(b["l"].alias("l"), b["t"].alias("t"), (b["r"] - 1).alias("r"), (b["b"] - 1).alias("b"))


@_operator(IMAGE)
def moved(image, dx, dy):
    """The image shifted by (-dx, -dy) as shifted() moves polygons; 0 where nothing comes from."""
    a = array_of(image)
    out = np.zeros_like(a)
    h, w = a.shape[:2]
    y, x = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if y.start < y.stop and x.start < x.stop:
        out[y, x] = a[y.start + dy : y.stop + dy, x.start + dx : x.stop + dx]
    return image_of(out)


def augmented(found: DataFrame, copies: int, shift: int, seed: int, images: tuple[str, ...] = (), augment: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Lines with `copies` seeded shifts of their polygons, and of the images and masks in the columns named; copies without area are dropped with their texts.

    augment: takes the shifted rows, with `iteration` (0: the line itself), and gives them back changed as it likes; the check of areas comes after it.
    """
    from vellum.functions.nested import box, has_area, shifted

    rows = found.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    move = lambda k: F.when(F.col("iteration") == 0, 0).otherwise(F.pmod(F.xxhash64("page_id", "line_pos", "iteration", F.lit(seed), F.lit(k)), F.lit(2 * shift + 1)).cast("int") - shift)
    rows = rows.withColumn("coords", shifted(F.col("coords"), move(0), move(1)))
    for c in images:
        rows = rows.withColumn(c, moved(image=F.col(c), dx=move(0), dy=move(1)))
    rows = augment(rows) if augment else rows
    return rows.filter(has_area(box(F.col("coords"))))


@_operator(T.LongType())
def pixels(inside):
    """Number of set samples of an image."""
    return int(np.count_nonzero(np.frombuffer(inside["data"], np.uint8)))
