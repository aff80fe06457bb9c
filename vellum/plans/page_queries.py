"""Registered queries over pages, line images, reports and alphabets of several characters, with their SQL; see queries.py for what stands for what."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum import schemas
from vellum.operators import alphabet as alpha
from vellum.operators import layout, profile, raster
from vellum.operators.alphabet import Alphabet
from vellum.plans import jobs
from vellum.plans.queries import _LKNOWN, _LMOVED, _Q, ALPHABET, LETTERS, READ_FROM, READ_TO, _pages, _parsed, _reduced_sql, _round, _table, query
from vellum.sources import pagexml, tables


@query(r"SELECT conv_id, 'l' || turn AS line_id, 'r_' || role AS region_id, text, CAST(turn * 20 + 15 AS INT) AS base FROM conversations WHERE regexp_matches(text, '\S')")
def json_roundtrip(spark, d):
    """Pages written as JSON, read by the declared schema, written as XML and read again."""
    json = jobs.xml_to_json(_parsed(spark, d), "conv_id")
    read = json.select("conv_id", F.from_json("json", schemas.DOCUMENT).alias("p")).select("conv_id", "p.*")
    again = jobs.json_to_xml(read, "conv_id").select("conv_id", pagexml.parsed(F.col("xml"), True).alias("p")).select("conv_id", "p.*")
    return pagexml.lines(again, "conv_id").select("conv_id", "line_id", F.col("region_ids")[0].alias("region_id"), "text", F.col("baseline")[0][1].alias("base"))


@query(r"""SELECT conv_id, 'r_' || role AS region_id, 13 AS width, 17 AS height, count(*) AS n_lines, string_agg('l' || turn || ':' || (turn * 20 + 7) || ':' || text, '|' ORDER BY turn) AS lines
FROM conversations WHERE regexp_matches(text, '\S') GROUP BY conv_id, role""")
def region_documents(spark, d):
    """A document for each region that owns a line, its lines in the frame of the region's box, which begins at (-3, -7)."""
    pages = _parsed(spark, d)
    corners = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((-3, -7), (9, -7), (9, 9), (-3, 9))))
    found = layout.region_documents(pages, pagexml.regions(pages, "conv_id").withColumn("coords", corners), pagexml.lines(pages, "conv_id"), "conv_id")
    read = found.select("conv_id", "region_id", F.from_json("json", schemas.DOCUMENT).alias("p"))
    text = F.transform("p.lines", lambda x: F.concat_ws(":", x["id"], x["coords"][0][1].cast("string"), x["text"]))
    return read.select("conv_id", "region_id", F.col("p.image_width").alias("width"), F.col("p.image_height").alias("height"), F.size("p.lines").cast("long").alias("n_lines"), F.array_join(text, "|").alias("lines"))


@query(r"SELECT DISTINCT conv_id, 'r_' || role AS region_id FROM conversations WHERE regexp_matches(text, '\S')")
def owned_regions(spark, d):
    """Regions that own a line with text."""
    pages = _pages(spark, d)
    found = pagexml.lines(pages, "conv_id").filter(F.col("text").rlike(r"\S"))
    return layout.without_empty(pagexml.regions(pages, "conv_id"), found, "conv_id").select("conv_id", "region_id").distinct()


@query("""WITH p AS (SELECT doc_id, max(length(t)) * count(*) AS pixels FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY doc_id)
SELECT doc_id, CAST(pixels AS BIGINT) AS pixels, CASE WHEN pixels > 2000 THEN 'too large' ELSE 'kept' END AS reason FROM p""")
def page_sizes(spark, d):
    """Pages by their pixels (characters): those that are small enough, and the log of the others."""
    lines = profile.text_lines(profile.spread(_table(spark, d, "documents").select("doc_id", "text")), ["doc_id"])
    pages = lines.groupBy("doc_id").agg(F.max(F.length("text")).alias("image_width"), F.count(F.lit(1)).alias("image_height"))
    small, log = layout.by_size(pages, 2000, key="doc_id")
    kept = small.select("doc_id", (F.col("image_width") * F.col("image_height")).cast("long").alias("pixels"), F.lit("kept").alias("reason"))
    return kept.unionByName(log)


@query(r"SELECT count(*) AS n_lines, count(DISTINCT conv_id) AS n_files FROM conversations WHERE regexp_matches(text, '\S')")
def compiled_counts(spark, d):
    """Lines and files of a compiled data set."""
    return jobs.compiled_counts(jobs.compile_lines(_parsed(spark, d), "conv_id"), "conv_id")


_PREDICTED = f"translate(text, '{READ_FROM}', '{READ_TO}')"


@query(f"SELECT conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, {_PREDICTED} AS prediction, {_reduced_sql('text')} AS reduced, text AS gt FROM conversations ORDER BY id, prediction, gt LIMIT 40")
def sample_log(spark, d):
    """The first 40 samples of a run, for its log."""
    rows = _table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), F.translate("text", READ_FROM, READ_TO).alias("prediction"), F.col("text").alias("gt"))
    return jobs.sample_log(rows, ALPHABET, 40)


@query(f"""WITH g AS (SELECT role, {_reduced_sql('text')} AS gt, translate({_reduced_sql('text')}, '{READ_FROM}', '{READ_TO}') AS pred FROM conversations),
x AS (SELECT role, length(gt) AS n, CASE WHEN gt = pred THEN 0 WHEN gt = '' OR pred = '' THEN greatest(length(gt), length(pred)) ELSE levenshtein(pred, gt) END AS e FROM g)
SELECT role, count(*) FILTER (n > 0) AS n, count(*) FILTER (n = 0) AS n_empty, round(avg(e / n) FILTER (n > 0), 6) AS cer, round(avg(CAST(e > 0 AS DOUBLE)) FILTER (n > 0), 6) AS ler, round(sum(e) / sum(n), 6) AS cer_micro FROM x GROUP BY role""")
def evaluated_roles(spark, d):
    """A whole evaluation by role: the ground truths as they are, the predictions in the alphabet's form."""
    rows = _table(spark, d, "conversations").select("role", F.translate(ALPHABET.reduce(F.col("text")), READ_FROM, READ_TO).alias("prediction"), F.col("text").alias("gt"))
    out = jobs.evaluate(rows, ALPHABET, ("role",))
    return out.select("role", "n", "n_empty", *(_round(F.col(c)).alias(c) for c in ("cer", "ler", "cer_micro")))


# alphabets

#: Symbols of several characters, some of them the beginning or the end of others.
COMPOUND = ("th", "the", "he", "in", "ing", "ion", "tion", "qu", "sh", "sch", "ch", "ä.", "..", "ou", "our", "ne", "one")
_CHARS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(ord("A"), ord("Z") + 1)), *"0123456789", " ", ".", ",", "-"]
COMPOUNDS = Alphabet.from_classes([*_CHARS, *COMPOUND])
FOLDED = Alphabet.from_classes(_CHARS, case_folding=True)
_LONGEST = "|".join(sorted((s.replace(".", r"\.") for s in COMPOUND), key=lambda s: (-len(s.replace("\\", "")), s)))
_COMPOUND_CODES = "MAP {" + ", ".join(f"{_Q(s)}: {c}" for s, c in COMPOUNDS.codes.items()) + "}"


@query(f"""WITH m AS (SELECT {_COMPOUND_CODES} AS m), t AS (SELECT doc_id, regexp_extract_all(text, '(?s){_LONGEST}|.') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(list_transform(s, lambda x: coalesce(m[x], 1)), ' ')) AS codes_md5 FROM t, m""")
def compound_codes(spark, d):
    """Codes of whole documents under an alphabet with symbols of several characters: the longest that begins at a place counts."""
    rows = _table(spark, d, "documents").select("doc_id", COMPOUNDS.encode(F.col("text"), normal=False).alias("codes"))
    return rows.select("doc_id", F.size("codes").alias("n"), F.md5(F.array_join(F.col("codes").cast("array<string>"), " ").cast("binary")).alias("codes_md5"))


_LOWER = f"translate(text, {_Q(''.join(map(chr, range(65, 91))))}, {_Q(''.join(map(chr, range(97, 123))))})"


@query(f"SELECT doc_id, md5(regexp_replace({_LOWER}, '[^{alpha.ranges({*FOLDED.codes, '?'})}]', '?', 'g')) AS folded_md5 FROM documents")
def folded_text(spark, d):
    """Whole documents under an alphabet that does not tell cases apart: its representatives are small letters."""
    return _table(spark, d, "documents").select("doc_id", F.md5(FOLDED.reduce(F.col("text")).cast("binary")).alias("folded_md5"))


# line images


@query("""WITH p AS (SELECT p_partkey, p_size % 9 + 2 AS w, p_size AS h FROM part)
SELECT p_partkey, CAST(w * h AS BIGINT) AS inside, CAST(w - 1 AS INT) AS r, CAST(h - 1 AS INT) AS b, CAST(w * h AS BIGINT) AS cropped, CAST(w * h AS BIGINT) AS kept, CAST(16 * h AS BIGINT) AS channel, CAST(w * h AS BIGINT) AS summed, CAST(w * h AS BIGINT) AS zeroed FROM p""")
def line_images(spark, d):
    """Masks of rectangular polygons on pages of 64 by 16: their boxes, crops, paddings to a width with their masks, channels and sums, as numbers of pixels that are set."""
    w, h = (F.col("p_size") % 9 + 2).cast("int"), F.col("p_size").cast("int")
    zero = F.lit(0)
    rows = profile.spread(_table(spark, d, "part").select("p_partkey", F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h)).alias("p")))
    rows = rows.withColumn("x", raster.mask_box(F.col("p")))
    m, s = raster.mask.step(points=F.col("p"), height=F.lit(64), width=F.lit(16)), raster.mask_sum.step(polygons=F.array("p", "p"), height=F.lit(64), width=F.lit(16))
    c, z = raster.crop.step(image=m, l=F.col("x.l"), t=F.col("x.t"), r=F.col("x.r"), b=F.col("x.b")), raster.zero_pad.step(image=s, inside=m)
    wide, kept = raster.padded.step(image=c, width=F.lit(16)), raster.padding_mask.step(image=c, width=F.lit(16))
    a = raster.alpha_channel.step(inside=wide, transparency=F.lit(0.5))
    counted = {"inside": m, "cropped": c, "kept": kept, "channel": a, "summed": s, "zeroed": z}
    n = raster.together(**{k: raster.pixels.step(inside=i) for k, i in counted.items()})
    rows = rows.select("p_partkey", F.col("x.r").cast("int").alias("r"), F.col("x.b").cast("int").alias("b"), n.alias("n"))
    return rows.select("p_partkey", "n.inside", "r", "b", "n.cropped", "n.kept", "n.channel", "n.summed", "n.zeroed")


# samples and reports


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS stem, octet_length(encode(d.url)) AS img_bytes, md5(regexp_replace(d.text, '\\s+$', '')) AS text_md5, l.quality IS NOT NULL AS has_channel
FROM (SELECT doc_id, source || '/' || doc_id AS url, text FROM documents) d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""".replace("\\\\", "\\"))
def line_samples(spark, d):
    """Images, texts, masks and channels joined by their stems; documents stand for texts, labels for channels, which some samples lack."""
    docs = _table(spark, d, "documents").withColumn("stem", F.col("doc_id").cast("string"))
    content = lambda rows, c: rows.select("stem", c.cast("binary").alias("content"))
    images = content(docs, F.concat_ws("/", "source", "stem"))
    channels = content(_table(spark, d, "labels").withColumn("stem", F.col("doc_id").cast("string")), F.col("quality").cast("string")).dropDuplicates(["stem"])
    found = tables.samples(images, content(docs, F.col("text")), images, channels)
    return found.select("stem", F.octet_length("img").cast("long").alias("img_bytes"), F.md5(F.col("transcription").cast("binary")).alias("text_md5"), F.col("img_channel").isNotNull().alias("has_channel"))


@query(f"SELECT conv_id, turn, substr(translate(regexp_replace(text, '[^{_LKNOWN}]', '?', 'g'), {_Q(''.join(_LMOVED))}, {_Q(''.join(_LMOVED.values()))}), 1, CAST(turn + 2 AS INT)) AS decoded FROM conversations")
def decoded_lengths(spark, d):
    """Codes of a padded batch decoded up to a length of each row's own."""
    return _table(spark, d, "conversations").select("conv_id", "turn", LETTERS.decode(LETTERS.encode(F.col("text"), normal=False), F.col("turn").cast("int") + 2).alias("decoded"))


@query(r"SELECT conv_id, 'reviewed' AS comments, '2024-05-01' AS created, count(*) AS n_lines, 0 AS n_texts FROM conversations WHERE regexp_matches(text, '\S') GROUP BY conv_id")
def stamped_pages(spark, d):
    """Page documents without their transcriptions, with a comment and a date."""
    pages = _parsed(spark, d)
    pages = pages.withColumn("lines", F.transform("lines", lambda x: x.withField("text", F.lit(None).cast("string")))).filter(F.size("lines") > 0)
    read = jobs.xml_to_json(pages, "conv_id").select("conv_id", F.from_json("json", schemas.DOCUMENT).alias("p")).select("conv_id", "p.*")
    out = layout.commented(read, "reviewed", "2024-05-01")
    return out.select("conv_id", "metadata.comments", "metadata.created", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: x["text"].isNotNull())).alias("n_texts"))


@query(f"SELECT conv_id || '-' || turn AS id, {_PREDICTED} AS prediction, text AS gt, turn || '.5 ' || length(role) || '.25' AS scores, role FROM conversations")
def prediction_report(spark, d):
    """Rows of a tab-separated report: predictions, ground truths, scores and metadata."""
    rows = _table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.translate("text", READ_FROM, READ_TO).alias("prediction"), F.col("text").alias("gt"), F.array(F.col("turn") + F.lit(0.5), F.length("role") + F.lit(0.25)).cast("array<double>").alias("scores"), "role")
    return tables.report(rows, ["role"])
