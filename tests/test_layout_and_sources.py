from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import nested
from vellum.operators import layout, profile, raster
from vellum.plans import jobs
from vellum.sources import pagexml, tables

XML = f"""<?xml version="1.0"?>
<PcGts xmlns="{pagexml.NAMESPACE}"><Metadata><Creator>me</Creator><Created>2020</Created></Metadata>
<Page imageFilename="dir/p.jpg" imageWidth="100" imageHeight="200">
<TextRegion id="r1"><Coords points="10,10 50,10 50,50 10,50"/>
 <TextLine id="l1" custom="c"><Coords points="12,12 60,12 60,20 12,20"/><Baseline points="12,19 60,19"/><TextEquiv><Unicode>one &amp; two</Unicode></TextEquiv></TextLine>
 <TextLine id="l2"><Coords points="12,22 40,22"/><TextEquiv><Unicode>no baseline</Unicode></TextEquiv></TextLine>
 <TextRegion id="r2"><Coords points="20,30 40,30 40,40 20,40"/>
  <TextLine id="l3"><Coords points="21,31 39,31 39,39 21,39"/><Baseline points="21,38 39,38"/><TextEquiv><Unicode>  </Unicode></TextEquiv></TextLine>
 </TextRegion>
</TextRegion>
<TextLine id="7"><Coords points="1,1 2,1 2,2 1,2"/><Baseline points="1,2 2,2"/></TextLine>
</Page></PcGts>"""


def test_parse():
    p = pagexml.parse(XML)
    assert (p["image_width"], p["image_height"], p["creator"], p["comments"]) == (100, 200, "me", None)
    assert [(x["line_id"], x["region_ids"]) for x in p["lines"]] == [("l1", ["r1"]), ("l3", ["r1", "r2"]), ("7", [])]
    assert p["regions"][0]["coords"] == [[10, 10], [60, 10], [60, 50], [10, 50]] and p["regions"][1]["parent_ids"] == ["r1"]
    assert [x["line_id"] for x in pagexml.parse(XML, with_text=True)["lines"]] == ["l1"]
    assert pagexml.parse(XML, boxes=False)["regions"][0]["coords"][1] == [50, 10]
    with pytest.raises(pagexml.LayoutError, match="leaves"):
        pagexml.parse(XML, strict=True)
    with pytest.raises(pagexml.LayoutError, match="name space"):
        pagexml.parse("<a/>")


def test_xml_is_a_fixed_point(spark):
    rows = spark.createDataFrame([("p", XML), ("bad", "<oops")], "page_id string, xml string")
    one = rows.select("page_id", pagexml.parsed(F.col("xml")).alias("p")).select("page_id", "p.*")
    assert "ParseError" in one.filter("page_id = 'bad'").first().error
    one = one.filter("error is null").drop("error")
    two = pagexml.emitted(one).select("page_id", pagexml.parsed(F.col("xml")).alias("p")).select("page_id", "p.*").drop("error")
    a, b = one.first().asDict(True), two.first().asDict(True)
    a["image_filename"] = "p.jpg"
    a["lines"][2]["line_id"] = "l7"
    assert a == b


def test_files_and_jobs(spark, tmp_path):
    (tmp_path / "p.lines.xml").write_text(XML)
    pages = pagexml.read(spark, str(tmp_path))
    assert pages.first().page_id == "p"
    lines = jobs.compile_lines(pages).orderBy("sample_id").collect()
    assert [(r.sample_id, r.width, r.height, r.coords[0]) for r in lines] == [("p-r1-l0", 49, 9, [2, 2]), ("p-r1-l1", 19, 9, [11, 21])]
    body = json.loads(jobs.xml_to_json(pages).first().json)
    assert body["lines"][1]["regions"] == ["r1", "r2"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "p.json").write_text(json.dumps(body, indent=2))
    again = tables.read_pages(spark, str(tmp_path / "j" / "p.json"))
    assert again.first().page_id == "p" and layout.lines(again).count() == 3 and layout.regions(again).first().r == 60
    assert "one &amp; two" in jobs.json_to_xml(again).first().xml
    assert layout.commented(again, "note", "today").first().metadata.comments == "note"


def test_region_nested_documents(spark):
    line = {"id": "a", "coords": [[1, 1], [3, 1], [3, 2]], "baseline": [[1, 2], [3, 2]], "text": "t"}
    doc = {"image_filename": "i", "image_width": 9, "image_height": 9, "regions": [{"id": "r", "coords": [[0, 0], [4, 0], [4, 4], [0, 4]], "lines": [line]}, {"id": "e", "coords": [[0, 0]]}]}
    page = spark.createDataFrame([("p", json.dumps(doc))], "page_id string, j string").select("page_id", F.from_json("j", schemas.DOCUMENT).alias("d")).select("page_id", "d.*")
    r = layout.lines(page).first()
    assert (r.line_id, r.region_ids, r.text) == ("a", ["r"], "t")
    regions = layout.without_empty(layout.regions(page), layout.lines(page))
    assert [x.region_id for x in regions.collect()] == ["r"]
    moved = layout.in_region(layout.lines(page), regions.withColumn("l", F.lit(1)))
    assert moved.first().coords == [[0, 1], [2, 1], [2, 2]]
    assert layout.usable(layout.lines(page), with_text=True).count() == 1
    assert layout.without_text(layout.lines(page)).first().text is None
    assert layout.extended(regions.withColumn("r", F.lit(2)), layout.lines(page)).first().r == 3
    assert layout.lift(layout.sink(layout.lines(page))).first().line_id == "a"


def test_injection(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], "p int, line_pos int, line_id string, text string")
    new = spark.createDataFrame([(1, 0, "a", "X"), (1, 1, "b", None)], rows.schema)
    assert [r.text for r in layout.injected(rows, new, ["p", "line_pos"]).orderBy("line_pos").collect()] == ["X", "y"]
    other = new.withColumn("line_id", F.lit("z"))
    with pytest.raises(Exception, match="different ids"):
        layout.injected(rows, other, ["p", "line_pos"]).collect()
    assert layout.injected(rows, other, ["p", "line_pos"], force=True).count() == 2
    with pytest.raises(Exception, match="different numbers"):
        layout.injected(rows, new.limit(1), ["p", "line_pos"]).collect()


def test_geometry(spark):
    df = spark.createDataFrame([([[1, 2], [5, 2], [5, 9], [1, 9]], [[1, 2], [4, 4]])], "a array<array<int>>, b array<array<int>>")
    r = df.select(nested.box(F.col("a")).alias("box"), nested.corner_box(F.col("a")).alias("corner"), nested.inside(F.col("b"), nested.box(F.col("a"))).alias("in_"), nested.inside(F.col("a"), nested.box(F.col("b"))).alias("out"), nested.point_text(F.col("b")).alias("t"), nested.deep_sorted(F.array(F.array(F.lit(3), F.lit(1)), F.array(F.lit(2)))).alias("s"), nested.has_area(nested.box(F.col("b"))).alias("area")).first()
    assert tuple(r.box) == tuple(r.corner) == (1, 2, 5, 9) and r.in_ and not r.out and r.t == "1,2 4,4" and r.s == [[1, 3], [2]] and r.area
    assert spark.range(1).select(nested.points(F.lit("1,2 3,4"))).first()[0] == [[1, 2], [3, 4]]
    assert spark.range(1).select(nested.padded(F.array(F.lit(1.0)), 3, 0.0)).first()[0] == [1.0, 0.0, 0.0]
    rows = spark.createDataFrame([("p", ["A", "B"], [1, 0, 1], [[0, 0, 1, 1], [1, 1, 2, 2], [2, 2, 3, 3]])], "page_id string, class_names array<string>, rect_classes array<int>, rect_LTRB array<array<int>>")
    assert [(c.pos, c.name, c.box[0]) for c in layout.crops(rows, ["B"]).collect()] == [(0, "B", 0), (2, "B", 2)]
    assert rows.select(nested.has_classes(F.col("rect_classes"), F.col("class_names"), ["A", "C"])).first()[0] == [True, None]
    cells = layout.in_grid(spark.createDataFrame([(0, 0, 4, 4), (3, 3, 5, 5)], "l int, t int, r int, b int"), F.lit(4), F.lit(4)).collect()
    assert [(c.col, c.row) for c in cells] == [(0, 0)]


def test_sample_lists(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", "text", [(2, 3), (9, 1)], 10, 20), ("b.png", 'q "uote', [], 1, 2), ("c.png", "<[x]>", [], 1, 2)], "img_path string, transcription string, expansion_masks array<struct<off:int,len:int>>, height int, width int")
    tables.write_samples(rows, str(tmp_path / "s"))
    assert sorted(map(tuple, tables.read_samples(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "plain.tsv").write_text("x.png\tabc<[(1, 2)]>\t3\t4\n")
    r = tables.read_samples(spark, str(tmp_path / "plain.tsv"), header=False).first()
    assert (r.transcription, [tuple(m) for m in r.expansion_masks], r.width) == ("abc", [(1, 2)], 4)


def test_sample_files(spark, tmp_path):
    for name, data in (("a-l0.png", b"img"), ("a-l0.gt.txt", b"text \n"), ("a-l0.bool.npy.gz", b"m"), ("b.png", b"x")):
        (tmp_path / name).write_bytes(data)
    png, gt, mask = (tables.files(spark, str(tmp_path), g, one_folder=True) for g in ("*.png", "*.gt.txt", "*.npy.gz"))
    r = tables.samples(png, gt, mask, mask.limit(0)).first()
    assert (r.stem, r.transcription, bytes(r.img), r.img_channel) == ("a-l0", "text", b"img", None)
    with pytest.raises(Exception, match="no mask"):
        tables.samples(png, gt, mask.limit(0)).collect()
    pairs = tables.paired(png, gt, ".png", ".gt.txt").collect()
    assert len(pairs) == 1 and tables.first_pages(png, 1).count() == 1
    work = tables.work_list(png.unionByName(png), ".png", ".json", ".htr.json", markers=gt)
    assert work.count() == 2 and tables.not_done(work, work.limit(1), ["img_path"]).count() == 1
    sums = tables.checksums(tables.files(spark, str(tmp_path)))
    whole = "".join(hashlib.md5((tmp_path / n).read_bytes()).hexdigest() for n in sorted(p.name for p in tmp_path.iterdir()))
    assert tables.tree_checksum(sums).first().md5 == hashlib.md5(whole.encode()).hexdigest()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.png").write_bytes(b"1")
    with pytest.raises(tables.SourceError):
        tables.files(spark, [str(tmp_path / "b.png"), str(tmp_path / "sub" / "c.png")], one_folder=True)


def test_line_tables_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "t"), ("s", 1, "u")], "sample_id string, iteration int, transcription string")
    tables.write_lines(rows, str(tmp_path / "l"))
    tables.write_lines(rows.filter("iteration = 1").withColumn("transcription", F.lit("new")), str(tmp_path / "l"))
    assert sorted(r.transcription for r in spark.read.parquet(str(tmp_path / "l")).collect()) == ["new", "t"]
    report = tables.report(spark.createDataFrame([("1", "p", "g", [0.12345])], "id string, prediction string, gt string, scores array<double>"))
    assert tuple(report.first()) == ("1", "p", "g", "0.1235")
    (tmp_path / "r.json").write_text('{"url": "u", "md5": "m"}')
    assert tables.read_resource(spark, str(tmp_path / "r.json")).first().md5 == "m"
    stats = profile.described(spark.createDataFrame([(1, 4), (2, 5)], "a int, b int"), ["a", "b"]).first()
    assert (stats.n, stats.a_mean, stats.b_median, stats.b_max) == (2, 1, 4, 5)


def images(spark, *arrays):
    return spark.createDataFrame([(raster.image_of(np.asarray(x, np.uint8)),) for x in arrays], f"image {raster.IMAGE.simpleString()}")


def pixels_of(row):
    return raster.array_of(row.asDict()).squeeze()


def test_masks(spark):
    box = [[1, 1], [4, 1], [4, 3], [1, 3]]
    want = np.zeros((5, 6), bool)
    want[1:3, 1:4] = True
    assert (raster.polygon_mask(box, 5, 6) == want).all()
    assert raster.polygon_mask([[0, 0], [8, 0], [0, 8]], 8, 8).sum() == 28 and not raster.polygon_mask([[0, 0], [1, 1]], 3, 3).any()
    df = spark.createDataFrame([(box,)], "p array<array<int>>")
    r = df.select(raster.mask(points=F.col("p"), height=F.lit(5), width=F.lit(6)).alias("m"), raster.mask_sum(polygons=F.array("p", "p"), height=F.lit(5), width=F.lit(6)).alias("s"), raster.mask_box(F.col("p")).alias("b")).first()
    assert (pixels_of(r.m) == want * 255).all() and (pixels_of(r.s) == want * 2).all() and tuple(r.b) == (1, 1, 3, 2)


def test_padding_and_channels(spark):
    a = np.arange(24).reshape(4, 6)
    inside = np.zeros((4, 6))
    inside[1:3, 1:4] = 255
    df = images(spark, a).crossJoin(images(spark, inside).withColumnRenamed("image", "m"))
    r = df.select(
        raster.zero_pad(image=F.col("image"), inside=F.col("m")).alias("z"), raster.median_pad(image=F.col("image"), inside=F.col("m")).alias("d"), raster.noise_pad(image=F.col("image"), inside=F.col("m"), seed=F.lit(1)).alias("n"),
        raster.alpha_channel(inside=F.col("m"), transparency=F.lit(0.4)).alias("a"), raster.gray_channel(image=F.col("image")).alias("g"), raster.blurry_channel(image=F.col("image"), size=F.lit(3)).alias("b"), raster.crop(image=F.col("image"), l=F.lit(1), t=F.lit(1), r=F.lit(2), b=F.lit(9)).alias("c"),
        raster.padded(image=F.col("image"), width=F.lit(8)).alias("p"), raster.padding_mask(image=F.col("image"), width=F.lit(8)).alias("pm"), raster.with_channel(image=F.col("image"), channel=F.col("m")).alias("w"), raster.resized(image=F.col("image"), height=F.lit(2), width=F.lit(3)).alias("s"),
    ).first()
    on = inside > 0
    assert (pixels_of(r.z) == a * on).all() and (pixels_of(r.d) == np.where(on, a, int(np.median(a[on])))).all() and (pixels_of(r.n)[on] == a[on]).all()
    assert (pixels_of(r.a) == np.where(on, 255, 102)).all() and (pixels_of(r.g) == a).all() and pixels_of(r.b)[1, 1] == a[:3, :3].mean() // 1
    assert (pixels_of(r.c) == a[1:, 1:3]).all() and pixels_of(r.p).shape == (4, 8) and pixels_of(r.pm)[:, :6].all() and not pixels_of(r.pm)[:, 6:].any()
    assert raster.array_of(r.w.asDict()).shape == (4, 6, 2) and pixels_of(r.s).shape == (2, 3)
    size = spark.range(1).select(raster.target_size(F.lit(64), F.lit(5000), 128, 2048).alias("s"), raster.target_size(F.lit(200), F.lit(50), 128, 2048).alias("t")).first()
    assert tuple(size.s) == (128, 2048) and tuple(size.t) == (128, 32)


def test_operators_together(spark):
    """Steps give what columns give, take nulls to nulls, and run once however many take them."""
    box = [[1, 1], [4, 1], [4, 3], [1, 3]]
    df = spark.createDataFrame([(k, box if k % 3 else None, k % 5) for k in range(300)], "k int, p array<array<int>>, r int").coalesce(1)
    m = raster.mask(points=F.col("p"), height=F.lit(5), width=F.lit(6))
    chained = df.select("k", "r", m.alias("m")).select("*", raster.crop(image=F.col("m"), l=F.lit(1), t=F.lit(1), r=F.col("r"), b=F.lit(9)).alias("c"))
    want = [tuple(r) for r in chained.select("k", "m", "c", raster.pixels(inside=F.col("c")).alias("n")).collect()]
    m = raster.mask.step(points=F.col("p"), height=F.lit(5), width=F.lit(6))
    c = raster.crop.step(m, F.lit(1), F.lit(1), F.col("r"), F.lit(9))
    got = df.select("k", raster.together(m=m, c=c, n=raster.pixels.step(c)).alias("o")).select("k", "o.*")
    assert [tuple(r) for r in got.collect()] == want and got.schema["n"].dataType.simpleString() == "bigint"
    assert {r[3] for r in want if r[0] % 3 == 0} == {None} and {r[3] for r in want if r[0] % 3} == {0, 2, 4, 6}
    drawn = raster._operator(raster.T.DoubleType())(lambda r: np.random.default_rng().random()).step(F.col("r"))
    same = raster._operator(raster.T.DoubleType())(lambda x, y: x - y).step(drawn, drawn)
    assert {r[0] for r in df.select(raster.together(d=same)["d"]).collect()} == {0.0}
    assert df.filter("k < 0").select(raster.together(m=m)).collect() == []


def test_augmentation(spark):
    rows = spark.createDataFrame([("p", 0, [[1, 1], [5, 1], [5, 5]], "t"), ("p", 1, [[1, 1], [5, 1]], "flat")], "page_id string, line_pos int, coords array<array<int>>, text string")
    out = raster.augmented(rows, 3, 4, seed=1).orderBy("iteration").collect()
    assert [r.iteration for r in out] == [0, 1, 2, 3] and out[0].coords == [[1, 1], [5, 1], [5, 5]] and {r.text for r in out} == {"t"}


def test_lines_of_unknown_regions_are_written(spark):
    square = [[0, 0], [9, 0], [9, 9]]
    regions_ = [{"region_pos": 0, "region_id": "r1", "parent_ids": [], "coords": square}, {"region_pos": 1, "region_id": "r3", "parent_ids": ["r2"], "coords": square}]
    at = [["r1"], ["r9"], ["r2", "r3"], None, []]
    lines_ = [{"line_id": f"l{k}", "line_pos": k, "region_ids": x, "coords": square, "baseline": None, "text": f"t{k}"} for k, x in enumerate(at)]
    xml = pagexml.written("a.png", 10, 10, regions_, lines_)
    assert [xml.count(f"<Unicode>t{k}</Unicode>") for k in range(5)] == [1] * 5


def test_pages_by_size(spark):
    pages = spark.createDataFrame([("a", 10, 10), ("b", 100_000, 100_000), ("c", None, 5)], "page_id string, image_width int, image_height int")
    kept, log = layout.by_size(pages, 100)
    assert sorted(r.page_id for r in kept.collect()) == ["a", "c"] and [tuple(r) for r in log.collect()] == [("b", 10**10, "too large")]


def test_region_documents(spark):
    import json

    found_regions = spark.createDataFrame([("p", "r1", 0, [], [[5, 6], [15, 6], [15, 26]]), ("p", "r2", 1, [], [[0, 0], [3, 3]])], "page_id string, region_id string, region_pos int, parent_ids array<string>, coords array<array<int>>")
    found_lines = spark.createDataFrame([("p", f"l{k}", k, ["r1"], [[5 + k, 7], [9, 9]], [[6, 8]], f"t{k}") for k in (1, 0)], "page_id string, line_id string, line_pos int, region_ids array<string>, coords array<array<int>>, baseline array<array<int>>, text string")
    (row,) = layout.region_documents(spark.createDataFrame([("p",)], "page_id string"), found_regions, found_lines).collect()
    assert (row.region_id, row.l, row.t, row.r, row.b) == ("r1", 5, 6, 15, 26)
    body = json.loads(row.json)
    assert (body["image_filename"], body["image_width"], body["image_height"]) == ("p-r1", 11, 21)
    assert [(x["id"], x["coords"], x["baseline"], x["text"]) for x in body["lines"]] == [(f"l{k}", [[k, 1], [4, 3]], [[1, 2]], f"t{k}") for k in (0, 1)]


def test_images_move_with_their_polygons(spark):
    import numpy as np

    image = np.arange(1, 31, dtype=np.uint8).reshape(5, 6)
    df = spark.createDataFrame([("p", 0, [[1, 1], [3, 1], [3, 3]], raster.image_of(image))], "page_id string, line_pos int, coords array<array<int>>, image struct<height:int,width:int,channels:int,data:binary>")
    got = raster.augmented(df, 6, 2, 1, ("image",)).collect()
    assert len(got) == 7 and len({str(r.coords) for r in got}) > 2
    for r in got:
        dx, dy = 1 - r.coords[0][0], 1 - r.coords[0][1]
        want = [[int(image[y + dy, x + dx]) if 0 <= y + dy < 5 and 0 <= x + dx < 6 else 0 for x in range(6)] for y in range(5)]
        assert np.frombuffer(r.image["data"], np.uint8).reshape(5, 6).tolist() == want


def boxes(rng, n, kinds, least=0.0):
    out = []
    for _ in range(n):
        w, h = rng.choice(kinds)
        x, y = rng.randint(-300, 300), rng.randint(-300, 300)
        out.append((x, y, x + rng.randint(0, w), y + rng.randint(0, h)))
    return out


@pytest.mark.parametrize("crowded", [64, 3, 0])
@pytest.mark.parametrize("scale", [1, 0.001])
def test_contained_finds_each_pair_once(spark, crowded, scale):
    rng = random.Random(4)
    small = [(p, k, *(v * scale for v in b)) for k, (p, b) in enumerate((p, b) for p in ("a", "b", None) for b in boxes(rng, 60, [(0, 0), (5, 5), (80, 3)]))]
    large = [(p, k, *(v * scale for v in b)) for k, (p, b) in enumerate((p, b) for p, n in (("a", 90), ("b", 4), (None, 9)) for b in boxes(rng, n, [(600, 40), (40, 600), (64, 64), (0, 0)]))]
    small += [("a", 900, *small[0][2:]), ("a", 901, None, 0.0, 1.0, 1.0), ("a", 902, 9.0 * scale, 0.0, 2.0 * scale, 1.0 * scale)]
    large += [("a", 900, *(v * scale for v in (-400, -400, 400, 400))), ("a", 901, *(v * scale for v in (-400, -400, 400, 400))), ("a", 902, *small[0][2:]), ("a", 903, None, 0.0, 1.0, 1.0), ("a", 904, *(v * scale for v in (400, 400, -400, -400)))]
    kind = "page_id string, {} int, {} double, {} double, {} double, {} double"
    inner = spark.createDataFrame([(p, k, *(None if v is None else float(v) for v in x)) for p, k, *x in small], kind.format("i", "l", "t", "r", "b"))
    outer = spark.createDataFrame([(p, k, *(None if v is None else float(v) for v in x)) for p, k, *x in large], kind.format("o", "ol", "ot", "or_", "ob"))
    ok = lambda x: None not in x and x[0] <= x[2] and x[1] <= x[3]
    want = sorted((i, o) for p, i, *x in small for q, o, *y in large if p == q and p is not None and ok(x) and ok(y) and x[0] >= y[0] and x[1] >= y[1] and x[2] <= y[2] and x[3] <= y[3])
    got = layout.contained(inner, outer, crowded=crowded)
    assert sorted((r.i, r.o) for r in got.collect()) == want and len(want) > 50
    assert got.columns == ["page_id", "i", "l", "t", "r", "b", "o", "ol", "ot", "or_", "ob"]


def test_contained_on_a_page_of_very_many_boxes(spark):
    """100,000 lines in 20,000 regions of one page: what meets in cells stays near the result, far below 2 * 10**9 pairs."""
    at = lambda c, k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)) * c).cast("int")
    inner = spark.range(100_000, numPartitions=4).select(F.pmod("id", F.lit(1)).alias("page_id"), "id", at(1, 1).alias("l"), at(1, 2).alias("t")).withColumns({"r": F.col("l") + 30, "b": F.col("t") + 5})
    outer = spark.range(20_000, numPartitions=4).select(F.pmod("id", F.lit(1)).alias("page_id"), F.col("id").alias("o"), at(1, 3).alias("ol"), at(1, 4).alias("ot")).withColumns({"or_": F.col("ol") + 900, "ob": F.col("ot") + 300})
    got = layout.contained(inner, outer)
    import numpy as np

    a, b = (np.array(x.select(*c).collect()) for x, c in ((inner, "l t r b".split()), (outer, "ol ot or_ ob".split())))
    a = a[np.argsort(a[:, 0])]
    lo, hi = np.searchsorted(a[:, 0], b[:, 0]), np.searchsorted(a[:, 0], b[:, 2] - 30, "right")
    want = sum(int(((a[x:y, 1] >= t) & (a[x:y, 3] <= u)).sum()) for x, y, t, u in zip(lo, hi, b[:, 1], b[:, 3], strict=True))
    assert got.count() == want > 1000
    met = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in met and "NestedLoop" not in met


def star(rng, n, size):
    """A polygon whose edges may cross."""
    return [[rng.randint(-size // 4, size + size // 4), rng.randint(-size // 4, size + size // 4)] for _ in range(n)]


def test_spans_are_those_of_the_mask(spark):
    rng = random.Random(9)
    shapes = [star(rng, rng.randint(3, 9), 40) for _ in range(60)] + [[[0, 0], [40, 0], [40, 30], [0, 30]], [[1, 1], [2, 2]], [], [[5, 5], [5, 5], [5, 5]]]
    for p in shapes:
        mask = np.zeros((30, 40), bool)
        for top, bottom in ((0, 11), (11, 30)):
            for y, lo, hi in zip(*raster.polygon_spans(p, top, bottom, 40), strict=True):
                assert top <= y < bottom and not mask[y, lo:hi].any()
                mask[y, lo:hi] = True
        assert (mask == raster.polygon_mask(p, 30, 40)).all()
    df = spark.createDataFrame([(k, p) for k, p in enumerate(shapes)] + [(99, None)], "k int, p array<array<int>>")
    got = {r.k: r.a for r in df.select("k", raster.area(F.col("p"), F.lit(30), F.lit(40)).alias("a")).collect()}
    assert got == {k: int(raster.polygon_mask(p, 30, 40).sum()) for k, p in enumerate(shapes)} | {99: None}


@pytest.mark.parametrize("tile", [7, 256])
def test_sums_of_masks_by_tile(spark, tile):
    rng = random.Random(10)
    rows = [(page, k, star(rng, rng.randint(3, 7), 50)) for page in ("a", "b", None) for k in range(12)] + [("a", 90, None), ("b", 91, [])]
    df = spark.createDataFrame(rows, "page_id string, line int, coords array<array<int>>").repartition(3)
    want = {page: sum(raster.polygon_mask(p, 45, 60).astype(int) for q, _, p in rows if q == page and p) for page in ("a", "b", None)}
    found = {page: np.zeros((70, 300), int) for page in want}
    tiles = raster.mask_tiles(df, ["page_id"], "coords", 45, 60, tile)
    for r in tiles.collect():
        assert all(x.lo < x.hi and x.y // tile == r.tile_row and x.lo // tile == (x.hi - 1) // tile == r.tile_col for x in r.runs)
        for x in r.runs:
            found[r.page_id][x.y, x.lo : x.hi] += x.n
    assert all((found[k][:45, :60] == w).all() and found[k].sum() == w.sum() for k, w in want.items())
    cover = {r.page_id: (r.covered, r.total, r.most) for r in raster.page_cover(df, ["page_id"], "coords", 45, 60, tile).collect()}
    assert cover == {k: (int((w > 0).sum()), int(w.sum()), int(w.max())) for k, w in want.items()}
    image = tiles.select("page_id", "tile_row", "tile_col", raster.tile_image(runs=F.col("runs"), row=F.col("tile_row"), col=F.col("tile_col"), tile=F.lit(tile)).alias("i")).filter("page_id = 'a' and tile_row = 0 and tile_col = 0").first().i
    part = raster.array_of(image.asDict())[:, :, 0]
    assert (part[:45, :60] == want["a"][:tile, :tile]).all()


def test_a_page_too_large_for_a_bitmap(spark):
    """10**6 by 10**6 pixels: a thin frame and a square."""
    n = 1_000_000
    df = spark.createDataFrame([("p", [[0, 10], [n, 10], [n, 12], [0, 12]]), ("p", [[n - 300, 0], [n, 0], [n, 300], [n - 300, 300]])], "page_id string, coords array<array<int>>")
    assert tuple(raster.page_cover(df, ["page_id"], "coords", n, n, 4096).first()) == ("p", 2 * n + 300 * 300 - 600, 2 * n + 300 * 300, 2)


def test_polygons_of_small_pages_travel_as_they_are(spark):
    """Not their spans by tile: the shuffle files of pages of 9 by 60 pixels are smaller than the polygons' own rows."""
    n, x, q = 20_000, F.col("id") % 5, (F.col("id") % 30 + 20).cast("int")
    corner = lambda a, b: F.array(a.cast("int"), b)
    df = spark.range(n).select((F.col("id") / 4).cast("long").alias("page"), F.array(corner(x, q / 2), corner(x + 3, q / 2), corner(x + 3, q.cast("double")), corner(x, q.cast("double"))).cast("array<array<int>>").alias("coords"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(False))
    total = lambda: sum(e.totalShuffleWrite() for e in written())
    before = total()
    got = raster.page_cover(df, ["page"], "coords", 60, 9, 8).agg(F.count("page"), F.sum("total")).first()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got[0] == n // 4
    assert total() - before < 64 * n


def test_incremental_jobs_make_each_output_once(spark, tmp_path):
    from vellum.streaming import incremental

    def put(name, *rows):
        (tmp_path / "new").mkdir(exist_ok=True)
        (tmp_path / "new" / name).write_text("".join(json.dumps({"page_id": k, "text": t}) + "\n" for k, t in rows))

    def run(done=None, work=lambda df: df.select("page_id", F.upper("text").alias("text"))):
        source = spark.readStream.schema("page_id string, text string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/new")
        incremental.advance(source, work, ["page_id"], f"{tmp_path}/out", f"{tmp_path}/state", done)
        return sorted((r.page_id, r.text) for r in incremental.outputs(spark, f"{tmp_path}/out").collect())

    def dies(number):
        raise RuntimeError("lost after the output, before the commit")

    def broken(df):
        return df.select("page_id", F.raise_error(F.lit("lost in the middle of a batch")).cast("string").alias("text"))

    put("1.json", ("a", "x"), ("b", "y"), ("b", "y"))
    assert run() == [("a", "X"), ("b", "Y")]
    assert run() == [("a", "X"), ("b", "Y")]
    put("2.json", ("c", "z"), ("a", "again"))
    put("3.json", ("d", "w"))
    for options in ({"done": dies}, {"work": broken}):
        with pytest.raises(Exception, match="lost"):
            run(**options)
    assert run() == [("a", "X"), ("b", "Y"), ("c", "Z"), ("d", "W")]
    assert run() == [("a", "X"), ("b", "Y"), ("c", "Z"), ("d", "W")]


def test_a_chain_of_incremental_jobs(spark, tmp_path):
    """Pages to regions to lines to texts; one run dies in the middle step."""
    from vellum.streaming import incremental

    def put(name, *pages):
        (tmp_path / "new").mkdir(exist_ok=True)
        (tmp_path / "new" / name).write_text("".join(json.dumps({"page_id": p, "regions": r}) + "\n" for p, r in pages))

    def run(broken=False):
        lost = F.raise_error(F.lit("lost")).cast("string")
        steps = [
            ("regions", ["page_id"], lambda df: df.select("page_id", F.posexplode("regions").alias("region", "text"))),
            ("lines", ["page_id", "region"], lambda df: df.select("page_id", "region", F.posexplode(F.split("text", "/")).alias("line", "text")).withColumn("text", lost if broken else F.col("text"))),
            ("texts", ["page_id", "region", "line"], lambda df: df.withColumn("text", F.upper("text"))),
        ]
        found = incremental.chain(spark.readStream.schema("page_id string, regions array<string>").json(f"{tmp_path}/new"), steps, f"{tmp_path}/work")
        return found and sorted((r.page_id, r.region, r.line, r.text) for r in found.collect())

    (tmp_path / "new").mkdir()
    assert run() is None
    put("1.json", ("a", ["x/y", "z"]))
    first = [("a", 0, 0, "X"), ("a", 0, 1, "Y"), ("a", 1, 0, "Z")]
    assert run() == first
    put("2.json", ("b", ["u"]), ("a", ["again"]))
    with pytest.raises(Exception, match="lost"):
        run(broken=True)
    assert run() == [*first, ("b", 0, 0, "U")] == run()


def test_augmentation_by_a_function(spark):
    rows = spark.createDataFrame([("p", 0, [[1, 1], [5, 1], [5, 5]], "t")], "page_id string, line_pos int, coords array<array<int>>, text string")
    grow = lambda df: df.withColumn("coords", F.when(F.col("iteration") == 0, F.col("coords")).otherwise(F.transform("coords", lambda p: F.array(p[0] * 2, p[1] * 0)))).withColumn("text", F.upper("text"))
    out = raster.augmented(rows, 2, 0, seed=1, augment=grow).collect()
    assert [(r.iteration, r.text) for r in out] == [(0, "T")]  # flat copies go


def test_documents_are_read_in_slices_and_once(spark):
    """A filter on what was read does not read again, and few documents are Python objects at a time."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"xml": ["x" * 100] * 150 + ["y" * (3 << 20)] * 2})
    sizes = [len(x) for x in pagexml._slices(batch)]
    assert max(sizes) <= 64 and sum(sizes) == 152 and sizes[-2:] == [1, 1]
    df = spark.createDataFrame([("a",)], "xml string").select(pagexml.parsed(F.col("xml")).alias("p")).select("p.*").filter(F.size("lines") > 0)
    assert df._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
