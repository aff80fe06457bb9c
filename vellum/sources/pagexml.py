"""PageXML documents: read to flat page, region and line tables, and written from them.

Regions nest to any depth, which a Spark schema cannot express; an Arrow function walks each document once and returns
flat arrays.  A region's lines come once, with their regions from the outermost to the innermost.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.functions.batches import slices as _slices

#: The name space and schema of what is written.
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"
SCHEMA_LOCATION = f"{NAMESPACE} {NAMESPACE}/pagecontent.xsd"
LINE = "struct<line_pos:int,line_id:string,region_ids:array<string>,coords:array<array<int>>,baseline:array<array<int>>,text:string,custom:string>"
REGION = "struct<region_pos:int,region_id:string,parent_ids:array<string>,coords:array<array<int>>>"
PARSED = f"image_filename string, image_width int, image_height int, created string, creator string, comments string, regions array<{REGION}>, lines array<{LINE}>, error string"


FIELDS = ["image_filename", "image_width", "image_height", "created", "creator", "comments", "regions", "lines", "error"]


class LayoutError(ValueError):
    """A document that is not usable PageXML."""


def _points(text: str) -> list[list[int]]:
    return [[int(v) for v in p.split(",")] for p in text.split()]


def _box(points: list[list[int]]) -> list[int]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return [min(xs), min(ys), max(xs), max(ys)]


def _corners(b: list[int]) -> list[list[int]]:
    return [[b[0], b[1]], [b[2], b[1]], [b[2], b[3]], [b[0], b[3]]]


def parse(xml: str, with_text: bool = False, boxes: bool = True, strict: bool = False) -> dict:
    """PARSED of one document.

    Lines need a baseline and a polygon, with_text also a text that is not blank; others are dropped.  boxes: regions become
    boxes, grown to hold their lines.  strict: a line outside its region's box is an error.
    """
    root = ET.fromstring(xml)
    space = re.match(r"\{[^}]*\}", root.tag)
    if not space:
        raise LayoutError("no name space")
    ns = space.group()
    page = root.find(f"{ns}Page")
    if page is None:
        raise LayoutError("no page")
    meta = root.find(f"{ns}Metadata")
    meta = root.find(f"{ns}MetaData") if meta is None else meta
    said = lambda tag: None if meta is None or (e := meta.find(ns + tag)) is None else e.text
    regions: list[dict] = []
    lines: list[dict] = []

    def line(element: ET.Element, path: list[str]) -> list[int] | None:
        found = [None if (e := element.find(ns + tag)) is None else e.get("points") for tag in ("Coords", "Baseline")]
        if not all(found):
            return None
        unicode_ = element.find(f"{ns}TextEquiv/{ns}Unicode")
        text = None if unicode_ is None else unicode_.text
        if with_text and not (text or "").strip():
            return None
        coords = _points(found[0])
        lines.append({"line_pos": len(lines), "line_id": element.get("id"), "region_ids": path, "coords": coords, "baseline": _points(found[1]), "text": text, "custom": element.get("custom")})
        return _box(coords)

    def region(element: ET.Element, path: list[str]) -> list[int]:
        coords = _points(element.find(f"{ns}Coords").get("points"))
        own = _box(coords)
        entry = {"region_pos": len(regions), "region_id": element.get("id"), "parent_ids": path, "coords": coords}
        regions.append(entry)
        grown = own
        for child in element:
            inner = None
            if child.tag == f"{ns}TextLine":
                inner = line(child, [*path, element.get("id")])
                if inner and strict and (inner[0] < own[0] or inner[1] < own[1] or inner[2] > own[2] or inner[3] > own[3]):
                    raise LayoutError(f"line {child.get('id')} leaves region {element.get('id')}")
            elif child.tag == f"{ns}TextRegion":
                inner = region(child, [*path, element.get("id")])
            if inner:
                grown = [min(grown[0], inner[0]), min(grown[1], inner[1]), max(grown[2], inner[2]), max(grown[3], inner[3])]
        if boxes:
            entry["coords"] = _corners(grown)
        return grown

    for child in page:
        if child.tag == f"{ns}TextRegion":
            region(child, [])
        elif child.tag == f"{ns}TextLine":
            line(child, [])
    return {"image_filename": page.get("imageFilename"), "image_width": int(page.get("imageWidth")), "image_height": int(page.get("imageHeight")), "created": said("Created"), "creator": said("Creator"), "comments": said("Comments"), "regions": regions, "lines": lines, "error": None}


def parsed(xml: Column, with_text: bool = False, boxes: bool = True, strict: bool = False) -> Column:
    """parse() as a struct column; a document that fails has its reason in `error`, so that one bad page stops nothing."""

    kind = T.DataType.fromDDL(PARSED)
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for some in _slices(texts):
            out = []
            for t in some.to_pylist():
                try:
                    out.append(parse(t, with_text, boxes, strict))
                except (ET.ParseError, ValueError, AttributeError, TypeError) as e:
                    out.append(dict.fromkeys(FIELDS) | {"error": f"{type(e).__name__}: {e}"})
            parts.append(pa.array(out, made))
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    # not moved or repeated by the optimiser: a filter on what was read would parse each document twice
    run = run.asNondeterministic()
    return run(xml)


def read(spark: SparkSession, paths: str | list[str], glob: str = "*.xml", **options) -> DataFrame:
    """(page_id, parsed fields...) of files; page_id is the name without its suffixes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^/]*)?$", 1)
    return files.select(name.alias("page_id"), parsed(F.decode("content", "utf-8"), **options).alias("p")).select("page_id", "p.*")


def lines(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, F.explode("lines").alias("x")).select(key, "x.*")


def regions(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, F.explode("regions").alias("x")).select(key, "x.*")


def written(image: str, width: int, height: int, regions_, lines_, creator: str | None = None, created: str | None = None, comments: str | None = None, with_text: bool = True) -> str:
    """One document; lines go under their innermost region, and without any region under one that covers the page.

    A line whose regions are not among those of the page stands outside them, at the end of the page, so that none is lost.

    Ids without their letter get it (`r` for regions, `l` for lines that are numbers).  Regions keep their nesting.
    """
    regions_ = [dict(r) for r in regions_ if r is not None] if regions_ is not None else []
    lines_ = sorted((dict(x) for x in lines_ if x is not None), key=lambda x: x["line_pos"]) if lines_ is not None else []
    whole = not regions_
    if whole:
        regions_ = [{"region_pos": 0, "region_id": "r0", "parent_ids": [], "coords": [[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]]}]
    regions_.sort(key=lambda r: r["region_pos"])
    points = lambda c: " ".join(f"{p[0]:.0f},{p[1]:.0f}" for p in c)
    named = lambda i, letter: f"{letter}{i}" if (letter == "r" and not str(i).startswith("r")) or (letter == "l" and str(i).isdigit()) else str(i)
    out = ['<?xml version="1.0" encoding="utf-8"?>', f'<PcGts xmlns="{NAMESPACE}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="{SCHEMA_LOCATION}">', "<Metadata>"]
    out += [f"<{tag}>{escape(v)}</{tag}>" for tag, v in (("Creator", creator), ("Created", created), ("LastChange", created), ("Comments", comments)) if v is not None]
    out += ["</Metadata>", f'<Page imageFilename={quoteattr(image.rsplit("/", 1)[-1])} imageWidth="{width}" imageHeight="{height}">']

    path_of = lambda r: (*(r.get("parent_ids") if r.get("parent_ids") is not None else ()), r["region_id"])
    known: set[tuple] = set()
    for r in sorted(regions_, key=lambda r: len(path_of(r))):
        if len(path_of(r)) == 1 or path_of(r)[:-1] in known:
            known.add(path_of(r))

    def line(x):
        out.append(f"<TextLine id={quoteattr(named(x['line_id'], 'l'))}" + (f" custom={quoteattr(x['custom'])}" if x.get("custom") else "") + ">")
        out.append(f'<Coords points="{points(x["coords"])}"/>')
        if x.get("baseline") is not None:
            out.append(f'<Baseline points="{points(x["baseline"])}"/>')
        if with_text and x.get("text") is not None:
            out.append(f"<TextEquiv><Unicode>{escape(x['text'], {chr(13): '&#13;'})}</Unicode></TextEquiv>")
        out.append("</TextLine>")

    def region(r):
        path = [*(r.get("parent_ids") if r.get("parent_ids") is not None else []), r["region_id"]]
        out.append(f"<TextRegion id={quoteattr(named(r['region_id'], 'r'))}><Coords points=\"{points(r['coords'])}\"/>")
        for x in lines_:
            if whole or (x.get("region_ids") is not None and list(x["region_ids"]) == path):
                line(x)
        for s in regions_:
            if s.get("parent_ids") is not None and list(s["parent_ids"]) == path:
                region(s)
        out.append("</TextRegion>")

    for r in regions_:
        if r.get("parent_ids") is None or not len(r["parent_ids"]):
            region(r)
    for x in lines_:
        if not whole and (x.get("region_ids") is None or tuple(x["region_ids"]) not in known):
            line(x)
    return "\n".join([*out, "</Page>", "</PcGts>"])


def emitted(pages: DataFrame, key: str = "page_id", with_text: bool = True) -> DataFrame:
    """(page_id, xml) of pages with image_filename, image_width, image_height, regions, lines and maybe creator, created and comments."""
    extra = [c for c in ("creator", "created", "comments") if c in pages.columns]

    made = to_arrow_type(pages.schema[key].dataType)

    def run(batches):
        for p in (some for batch in batches for some in _slices(batch)):
            xml = [written(r["image_filename"], int(r["image_width"]), int(r["image_height"]), r["regions"], r["lines"], with_text=with_text, **{k: r[k] for k in extra}) for r in p.to_pylist()]
            yield pa.RecordBatch.from_arrays([p.column(0).cast(made), pa.array(xml, pa.string())], [key, "xml"])

    rows = pages.select(key, "image_filename", "image_width", "image_height", "regions", "lines", *extra)
    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, xml string")
