"""The registered queries, each over the whole of its tables, and SQL for those that SQL can express.

The tables hold no page images; lines of documents stand for transcriptions, conversations for pages of lines, embeddings for class
scores of frames, events for label streams, and orders for polygons (line number, quantity).  A fixed rewriting of
the ground truth stands for a recogniser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import bands, charsets, distance, nested
from vellum.functions import text as texts
from vellum.operators import alphabet as alpha
from vellum.operators import decoding, layout, metrics, profile, ranking, raster, sampling
from vellum.operators.alphabet import Alphabet
from vellum.plans import jobs, network_spec
from vellum.sources import pagexml, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


STANDARD = charsets.standard()
ALPHABET = Alphabet.from_classes(STANDARD)
LETTERS = Alphabet.from_classes([*charsets.SPACE, *charsets.latin(), *charsets.PUNCTUATION])
_OF = ALPHABET.representatives
_MOVED = {s: _OF[c] for s, c in ALPHABET.codes.items() if _OF[c] != s}
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_KNOWN = alpha.ranges({*ALPHABET.codes, "?"})
REDUCE_SQL = f"translate(regexp_replace({{0}}, '[^{_KNOWN}]', '?', 'g'), {_Q(''.join(_MOVED))}, {_Q(''.join(_MOVED.values()))})"


def _reduced_sql(x: str) -> str:
    return REDUCE_SQL.replace("{0}", x)


#: What the stand-in for a recogniser does to a line.
READ_FROM, READ_TO = "rnu", "mm"


def _lines(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return profile.text_lines(profile.spread(_table(spark, d, "documents").select("doc_id", *keys, "text")), ["doc_id", *keys])


def _read(rows: DataFrame) -> DataFrame:
    rows = profile.spread(rows)
    rows = rows.withColumn("gt", ALPHABET.reduce(F.col("text")))
    return rows.withColumn("pred", F.translate("gt", READ_FROM, READ_TO))


LINES_SQL = "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_pos FROM documents"
READ_SQL = f"l AS ({LINES_SQL}), g AS (SELECT *, {_reduced_sql('text')} AS gt FROM l), r AS (SELECT *, translate(gt, '{READ_FROM}', '{READ_TO}') AS pred FROM g)"


# pages, lines and their measures


@query("SELECT doc_id, CAST(line_pos AS INT) AS line_pos, text FROM (" + LINES_SQL + ")")
def line_explode(spark, d):
    return _lines(spark, d)


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
p AS (SELECT doc_id, count(*) AS height, max(length(t)) AS width, sum(length(t)) AS gt_length FROM l GROUP BY doc_id)
SELECT count(*) AS n, """ + ", ".join(f"CAST(floor({f}({c})) AS BIGINT) AS {c}_{m}" for c in ("height", "width", "gt_length") for m, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))) + " FROM p")
def page_stats(spark, d):
    pages = _lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("height"), F.max(F.length("text")).alias("width"), F.sum(F.length("text")).alias("gt_length"))
    return profile.described(pages, ["height", "width", "gt_length"])


@query("""
WITH l AS (SELECT lang, length(unnest(string_split(text, chr(10)))) AS gt_length FROM documents)
SELECT lang, count(*) AS n, """ + ", ".join(f"CAST(floor({f}(gt_length)) AS BIGINT) AS gt_length_{m}" for m, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))) + " FROM l GROUP BY lang")
def line_stats(spark, d):
    return profile.described(_lines(spark, d, "lang").withColumn("gt_length", F.length("text")), ["gt_length"], ["lang"])


@query("SELECT doc_id, count(*) AS n_lines, CAST(sum(length(t)) AS BIGINT) AS gt_length FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY doc_id")
def page_lengths(spark, d):
    return profile.page_lengths(_lines(spark, d), ["doc_id"])


# alphabets

CHARS_SQL = r"c AS (SELECT DISTINCT {k}, unnest(string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), '')) AS symbol FROM (SELECT {k}, unnest(string_split(text, chr(10))) AS line FROM documents)), s AS (SELECT * FROM c WHERE symbol <> '' AND (symbol = ' ' OR NOT regexp_matches(symbol, '\s')))"


@query("WITH " + CHARS_SQL.replace("{k}", "1 AS k") + " SELECT symbol FROM s")
def charset_distinct(spark, d):
    return alpha.charset(_table(spark, d, "documents"), "text")


@query("WITH " + CHARS_SQL.replace("{k}", "source") + " SELECT symbol, string_agg(source, ',' ORDER BY source) AS found_in FROM s WHERE symbol NOT IN (" + ", ".join(_Q(s) for g in STANDARD for s in g) + ") GROUP BY symbol")
def nonstandard_chars(spark, d):
    return alpha.where_found(alpha.unexpected(alpha.charset(_table(spark, d, "documents"), "text", ["source"]), STANDARD), "source")


@query("WITH " + CHARS_SQL.replace("{k}", "source") + " SELECT symbol, count(*) AS n_sources FROM s GROUP BY symbol")
def charset_by_source(spark, d):
    return alpha.charset(_table(spark, d, "documents"), "text", ["source"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_sources"))


@query("WITH " + CHARS_SQL.replace("{k}", "1 AS k") + """, n AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) + 1 AS code FROM s), m AS (SELECT max(code) AS m FROM n)
SELECT symbol, CAST(code AS BIGINT) AS code FROM n WHERE symbol NOT IN ('ϵ', '?', '↦', '⇥') UNION ALL SELECT 'ϵ', 0 UNION ALL SELECT '?', 1 UNION ALL SELECT '↦', m + 1 FROM m UNION ALL SELECT '⇥', m + 2 FROM m""")
def alphabet_codes(spark, d):
    return alpha.coded(alpha.charset(_table(spark, d, "documents"), "text"))


@query("WITH " + CHARS_SQL.replace("{k}", "lang") + """, a AS (SELECT symbol FROM s WHERE lang = 'fr'), b AS (SELECT symbol FROM s WHERE lang = 'en')
SELECT 'both' AS side, symbol FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', symbol FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', symbol FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def alphabet_set_ops(spark, d):
    chars = alpha.charset(_table(spark, d, "documents"), "text", ["lang"])
    one, two = (chars.filter(F.col("lang") == x).select("symbol") for x in ("fr", "en"))
    side = lambda name, x: x.select(F.lit(name).alias("side"), "symbol")
    return side("both", one.intersect(two)).unionByName(side("first", one.exceptAll(two))).unionByName(side("second", two.exceptAll(one)))


@query("WITH " + CHARS_SQL.replace("{k}", "lang") + " SELECT lang, count(DISTINCT symbol) AS symbols FROM s GROUP BY lang")
def alphabet_stats(spark, d):
    return alpha.charset(_table(spark, d, "documents"), "text", ["lang"]).groupBy("lang").agg(F.count_distinct("symbol").alias("symbols"))


_CLASS_OF = {x: k for k, g in enumerate(STANDARD) for x in g}
_CLASS_OF |= {x: _CLASS_OF["i"] for x, k in _CLASS_OF.items() if k == _CLASS_OF["j"]}


@query("WITH " + CHARS_SQL.replace("{k}", "1 AS k") + f""", classes(symbol, g) AS (VALUES {", ".join(f"({_Q(x)}, '{k}')" for x, k in _CLASS_OF.items())}),
members AS (SELECT symbol, min(symbol) OVER (PARTITION BY coalesce(g, 'x' || symbol)) AS repr FROM s LEFT JOIN classes USING (symbol) WHERE symbol NOT IN ({", ".join(map(_Q, alpha.VIRTUAL))})),
numbered AS (SELECT symbol, CAST(dense_rank() OVER (ORDER BY repr) + 1 AS INT) AS code, repr FROM members)
SELECT * FROM numbered UNION ALL SELECT x.symbol, CAST(x.code + CASE WHEN x.code < 2 THEN 0 ELSE (SELECT max(code) FROM numbered) - 1 END AS INT), x.symbol
FROM (VALUES ({_Q(alpha.NULL)}, 0), ({_Q(alpha.UNKNOWN)}, 1), ({_Q(alpha.START)}, 2), ({_Q(alpha.END)}, 3)) AS x(symbol, code)""")
def alphabet_prototype(spark, d):
    """The many-to-one alphabet of all documents, by the standard classes."""
    return Alphabet.prototype(_table(spark, d, "documents"), "text", STANDARD, ["ij"]).table(spark)


@query("WITH " + CHARS_SQL.replace("{k}", "lang") + " SELECT symbol, count(DISTINCT lang) AS n FROM s GROUP BY symbol HAVING count(DISTINCT lang) > 1")
def duplicate_symbols(spark, d):
    """Symbols that stand in more than one class, where the characters of each language are a class."""
    found = alpha.charset(_table(spark, d, "documents"), "text", ["lang"])
    return alpha.repeated(found.groupBy("lang").agg(F.collect_list("symbol").alias("symbols")), "symbols")


@query("""
WITH x AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE list_sort(list_distinct(string_split(text, ''))) END AS s FROM documents)
SELECT doc_id, array_to_string(list_transform(CASE WHEN list_contains(s, 'ϵ') THEN [] ELSE ['ϵ'] END || s, lambda c: c || coalesce(list_position(s, c), 0)), ' ') AS codes FROM x""")
def text_alphabets(spark, d):
    """Each document's own alphabet."""
    rows = _table(spark, d, "documents").select("doc_id", alpha.own_codes(F.col("text")).alias("c"))
    return rows.select("doc_id", F.array_join(F.transform("c", lambda x: F.concat(x["symbol"], x["code"].cast("string"))), " ").alias("codes"))


NORMAL_SQL = "replace(replace(replace(replace(replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE')"


@query("SELECT doc_id, md5(" + NORMAL_SQL.replace("{0}", "text") + ") AS normal_md5 FROM documents")
def normalize_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(texts.normalized(F.col("text")).cast("binary")).alias("normal_md5"))


@query(f"SELECT doc_id, md5({_reduced_sql('text')}) AS reduced_md5 FROM documents")
def reduce_charset(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(ALPHABET.reduce(F.col("text")).cast("binary")).alias("reduced_md5"))


_CODES_SQL = "MAP {" + ", ".join(f"{_Q(s)}: {c}" for s, c in LETTERS.codes.items()) + "}"


@query(f"""
WITH m AS (SELECT {_CODES_SQL} AS m),
c AS (SELECT conv_id, turn, unnest(string_split(t, '')) AS s, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT conv_id, turn, {NORMAL_SQL.replace('{0}', 'text')} AS t FROM conversations)),
e AS (SELECT conv_id, turn, i, coalesce(m[s], 1) AS code FROM c, m WHERE s <> '')
SELECT conv_id, turn, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY i) AS codes FROM e GROUP BY conv_id, turn
UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE {NORMAL_SQL.replace('{0}', 'text')} = ''""")
def encode_lines(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", F.array_join(LETTERS.encode(F.col("text")).cast("array<string>"), " ").alias("codes"))


_LOF = LETTERS.representatives
_LMOVED = {s: _LOF[c] for s, c in LETTERS.codes.items() if _LOF[c] != s}
_LKNOWN = alpha.ranges({*LETTERS.codes, "?"})


@query(f"SELECT conv_id, turn, translate(regexp_replace({NORMAL_SQL.replace('{0}', 'text')}, '[^{_LKNOWN}]', '?', 'g'), {_Q(''.join(_LMOVED))}, {_Q(''.join(_LMOVED.values()))}) AS decoded FROM conversations")
def decode_roundtrip(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", LETTERS.decode(LETTERS.encode(F.col("text"))).alias("decoded"))


@query(f"""
WITH m AS (SELECT {_CODES_SQL} AS m),
c AS (SELECT unnest(string_split({NORMAL_SQL.replace('{0}', 'text')}, '')) AS s FROM benchmark)
SELECT CAST(coalesce(m[s], 1) AS BIGINT) AS code, count(*) AS n FROM c, m WHERE s <> '' GROUP BY 1""")
def one_hot_histogram(spark, d):
    rows = _table(spark, d, "benchmark").select(F.explode(LETTERS.encode_one_hot(F.col("text"))).alias("row"))
    return rows.select((F.array_position("row", 1) - 1).cast("long").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(translate(text, '.,;:-', '')) AS kept_md5 FROM documents")
def drop_ignored_chars(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(texts.without(F.col("text"), ".,;:-").cast("binary")).alias("kept_md5"))


# error rates


@query(f"""WITH {READ_SQL}, x AS (SELECT lang, length(gt) AS n, CASE WHEN gt = pred THEN 0 WHEN gt = '' OR pred = '' THEN greatest(length(gt), length(pred)) ELSE levenshtein(pred, gt) END AS e FROM r)
SELECT lang, count(*) FILTER (n > 0) AS n, count(*) FILTER (n = 0) AS n_empty, round(avg(e / n) FILTER (n > 0), 6) AS cer, round(avg(CAST(e > 0 AS DOUBLE)) FILTER (n > 0), 6) AS ler, round(sum(e) / sum(n), 6) AS cer_micro FROM x GROUP BY lang""")
def cer_by_lang(spark, d):
    """The flagship: error rates of a (stand-in) recogniser over all lines, by language."""
    out = metrics.error_rates(metrics.scored(_read(_lines(spark, d, "lang")), words=False), ["lang"])
    return out.select("lang", "n", "n_empty", *(_round(F.col(c)).alias(c) for c in ("cer", "ler", "cer_micro")))


@query(f"""WITH {READ_SQL}, x AS (SELECT lang, doc_id, line_pos, length(gt) AS n, CASE WHEN gt = pred THEN 0 WHEN gt = '' OR pred = '' THEN greatest(length(gt), length(pred)) ELSE levenshtein(pred, gt) END AS e FROM r),
b AS (SELECT lang, CASE WHEN n > 0 THEN e / n END AS cer, (row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_pos) - 1) // 8 AS batch FROM x),
m AS (SELECT lang, batch, avg(cer) AS cer FROM b GROUP BY lang, batch)
SELECT lang, count(*) AS n_batches, round(avg(cer), 6) AS cer_batched FROM m GROUP BY lang""")
def cer_batched(spark, d):
    rows = metrics.scored(_read(_lines(spark, d, "lang")), words=False)
    return metrics.batched(rows, "doc_id", ["line_pos"], 8, ["lang"]).withColumn("cer_batched", _round(F.col("cer_batched")))


def _fold(a: str, b: str, cost: str = "1") -> str:
    """SQL for the distance of two lists by folds; cost is that of column j."""
    first = f"list_prepend(0::BIGINT, list_transform(range(1, len({b}) + 1), lambda j: CAST(list_sum(list_transform(range(1, j + 1), lambda j: {cost})) AS BIGINT)))"
    cell = f"CASE WHEN {a}[i[1]] = {b}[j[1]] THEN p[j[1]] ELSE least(p[j[1]], p[j[1] + 1], c[len(c)]) + ({cost.replace('j', 'j[1]')})::BIGINT END"
    row = f"list_reduce(list_prepend([i[1]], list_transform(range(1, len({b}) + 1), lambda x: [x])), lambda c, j: list_append(c, {cell}))"
    return f"list_reduce(list_prepend({first}, list_transform(range(1, len({a}) + 1), lambda x: [x])), lambda p, i: {row})[len({b}) + 1]"


@query(f"""
WITH x AS (SELECT item_id, string_split({_reduced_sql('text')}, ' ') AS ref, string_split(translate({_reduced_sql('text')}, 'rnu', 'mm'), ' ') AS hyp FROM benchmark)
SELECT item_id, CAST(len(ref) AS BIGINT) AS gt_words, CAST({_fold('hyp', 'ref')} AS BIGINT) AS word_errors FROM x""")
def wer_lines(spark, d):
    return metrics.scored(_read(_table(spark, d, "benchmark"))).select("item_id", "gt_words", "word_errors")


#: Words of each turn, as the recogniser's stand-in reads them, and the errors among them.
TURNS_SQL = f"""t AS MATERIALIZED (SELECT conv_id, turn, role, gt, translate(gt, '{READ_FROM}', '{READ_TO}') AS pred FROM (SELECT *, {_reduced_sql('text')} AS gt FROM conversations)),
w AS (SELECT *, string_split(gt, ' ') AS ref, string_split(pred, ' ') AS hyp FROM t),
e AS MATERIALIZED (SELECT conv_id, turn, role, gt, pred, CAST(len(ref) AS BIGINT) AS gt_words, CAST({_fold('hyp', 'ref')} AS BIGINT) AS word_errors FROM w)"""


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, gt_words, word_errors FROM e")
def wer_turns(spark, d):
    """wer_lines over each turn of conversations."""
    return metrics.scored(_read(_table(spark, d, "conversations"))).select("conv_id", "turn", "gt_words", "word_errors")


@query(f"""WITH {TURNS_SQL}, x AS (SELECT *, length(gt) AS n, CASE WHEN gt = pred THEN 0 WHEN gt = '' OR pred = '' THEN greatest(length(gt), length(pred)) ELSE levenshtein(pred, gt) END AS c FROM e)
SELECT role, count(*) FILTER (n > 0) AS n, count(*) FILTER (n = 0) AS n_empty, round(avg(c / n) FILTER (n > 0), 6) AS cer, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) FILTER (n > 0), 6) AS ler,
       round(avg(word_errors / gt_words) FILTER (n > 0), 6) AS wer, round(sum(c) / sum(n), 6) AS cer_micro, round(sum(word_errors) / sum(gt_words), 6) AS wer_micro FROM x GROUP BY role""")
def wer_conversations(spark, d):
    out = metrics.error_rates(metrics.scored(_read(_table(spark, d, "conversations"))), ["role"])
    return out.select("role", "n", "n_empty", *(_round(F.col(c)).alias(c) for c in ("cer", "ler", "wer", "cer_micro", "wer_micro")))


def _masks() -> Column:
    return F.array(F.struct(F.lit(5).alias("off"), F.lit(10).alias("len")), F.struct(F.lit(30).alias("off"), F.lit(4).alias("len")))



@query(f"""
WITH x AS (SELECT item_id, string_split({_reduced_sql('text')}, '') AS ref, string_split(translate({_reduced_sql('text')}, 'rnu', 'mm'), '') AS hyp FROM benchmark)
SELECT item_id, CAST({_fold('hyp', 'ref', "CASE WHEN (j > 5 AND j <= 15) OR (j > 30 AND j <= 34) THEN 0 ELSE 1 END")} AS BIGINT) AS masked_errors FROM x""")
def masked_distance(spark, d):
    rows = _read(_table(spark, d, "benchmark")).withColumn("masks", _masks())
    return metrics.mask_scored(rows).select("item_id", "masked_errors")


@query()
def masked_turns(spark, d):
    """masked_distance over each turn of conversations; SQL folds are too slow there."""
    rows = _read(_table(spark, d, "conversations")).withColumn("masks", _masks())
    return metrics.mask_scored(rows).select("conv_id", "turn", "masked_errors")


@query()
def mer_conversations(spark, d):
    rows = _read(_table(spark, d, "conversations")).withColumn("masks", _masks())
    return metrics.mask_rates(metrics.mask_scored(rows), ["role"]).select("role", "n", *(_round(F.col(c)).alias(c) for c in ("cer", "mer", "mask_share")))


@query(f"""
WITH {READ_SQL.split(', r AS')[0]}, p AS (SELECT doc_id, line_pos, gt, lag(gt) OVER (PARTITION BY doc_id ORDER BY line_pos) AS before FROM g)
SELECT doc_id, CAST(line_pos AS INT) AS line_pos FROM p WHERE before IS NOT NULL AND abs(length(gt) - length(before)) <= 3
AND (gt = before OR CASE WHEN gt = '' OR before = '' THEN greatest(length(gt), length(before)) ELSE levenshtein(gt, before) END <= 3)""")
def near_lines(spark, d):
    rows = _lines(spark, d).withColumn("gt", ALPHABET.reduce(F.col("text")))
    rows = rows.withColumn("before", F.lag("gt").over(Window.partitionBy("doc_id").orderBy("line_pos")))
    return rows.filter(distance.within(F.col("gt"), F.col("before"), 3)).select("doc_id", "line_pos")


@query()
def alignment_pairs(spark, d):
    rows = _read(_table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", F.size(distance.align("pred", "gt")).alias("n_aligned"), F.size(distance.align_lcs("pred", "gt")).alias("n_lcs"))


@query()
def confusion_counts(spark, d):
    out = metrics.confusions(_read(_table(spark, d, "conversations")))
    return out.select("gt_char", "pred_char", "n", _round(F.col("share")).alias("share"))


@query()
def confusion_documents(spark, d):
    """confusion_counts over every line of documents, by language."""
    out = metrics.confusions(_read(_lines(spark, d, "lang")), by=["lang"])
    return out.select("lang", "gt_char", "pred_char", "n", _round(F.col("share")).alias("share"))


@query()
def alignment_lines(spark, d):
    """alignment_pairs over every line of documents, the longest included."""
    rows = _read(_lines(spark, d))
    return rows.select("doc_id", "line_pos", bands.alignment_counts("pred", "gt").alias("n")).select("doc_id", "line_pos", "n.n_aligned", "n.n_lcs")


@query()
def confusion_batches(spark, d):
    out = metrics.mean_confusions(_read(_table(spark, d, "conversations")), "conv_id")
    return out.select("gt_char", "pred_char", _round(F.col("share")).alias("share"))


# decoding


@query("SELECT label AS sequence, vec_id, list_position(embedding, list_max(embedding)) - 1 AS frame_label, round(list_max(embedding), 5) AS score FROM embeddings")
def greedy_decode(spark, d):
    rows = _table(spark, d, "embeddings").withColumnRenamed("label", "sequence")
    return decoding.greedy_frames(rows, ["sequence", "vec_id"], "embedding").select("sequence", "vec_id", F.col("label").alias("frame_label"), F.round("score", 5).alias("score"))


@query("""
WITH e AS (SELECT user_id, event_id, ascii(event_type) % 4 AS label FROM events),
b AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, string_agg(CAST(label AS VARCHAR), ' ' ORDER BY event_id) AS labels FROM b WHERE label <> 0 AND (before IS NULL OR before <> label) GROUP BY user_id""")
def ctc_collapse(spark, d):
    frames = _table(spark, d, "events").select("user_id", "event_id", (F.ascii("event_type") % 4).alias("label"))
    return decoding.ctc_labels(frames, ["user_id"], "event_id").select("user_id", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


@query("""
WITH e AS (SELECT user_id, event_id, ascii(event_type) % 4 AS label, value FROM events),
b AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM e),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(label) AS label, max(value) AS score FROM r WHERE label <> 0 GROUP BY user_id, run""")
def ctc_scores(spark, d):
    frames = _table(spark, d, "events").select("user_id", "event_id", (F.ascii("event_type") % 4).alias("label"), "value")
    return decoding.ctc_scores(frames, ["user_id"], "event_id", score="value")


_REPRESENTATIVES = [LETTERS.representatives.get(c, alpha.UNKNOWN) for c in range(max(LETTERS.representatives) + 1)]


@query(f"""
WITH f AS (SELECT label AS sequence, vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS c FROM embeddings),
b AS (SELECT *, lag(c) OVER (PARTITION BY sequence ORDER BY vec_id) AS before FROM f),
k AS (SELECT * FROM b WHERE c <> 0 AND (before IS NULL OR before <> c))
SELECT sequence, coalesce(string_agg(coalesce([{', '.join(map(_Q, _REPRESENTATIVES))}][c + 1], '?'), '' ORDER BY vec_id), '') AS prediction, CAST(count(c) AS INT) AS n_scores
FROM (SELECT DISTINCT sequence FROM f) LEFT JOIN k USING (sequence) GROUP BY sequence""")
def frame_texts(spark, d):
    """Greedy texts and scores of frame arrays, a sequence for each label."""
    frames = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    rows = _table(spark, d, "embeddings").groupBy(F.col("label").alias("sequence")).agg(frames.alias("frames"))
    return jobs.decode(rows, LETTERS).select("sequence", "prediction", F.size("scores").alias("n_scores"))


@query()
def beam_decode(spark, d):
    rows = _table(spark, d, "embeddings").withColumnRenamed("label", "sequence")
    out = decoding.beam_decoded(rows, ["sequence"], "vec_id", "embedding")
    return out.select("sequence", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"), _round(F.col("log_p"), 4).alias("log_p"))


# layouts


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as pages: a region for each role, a line for each turn."""
    at = lambda x, y, w, h: F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    t, w = F.col("turn").cast("int"), F.length("text").cast("int")
    line = F.struct(t.alias("line_pos"), F.concat(F.lit("l"), F.col("turn").cast("string")).alias("line_id"), F.array("role").alias("region_ids"), at(F.lit(0), t * 20, w, 20).alias("coords"), F.array(F.array(F.lit(0), t * 20 + 15), F.array(w, t * 20 + 15)).alias("baseline"), F.col("text"), F.lit(None).cast("string").alias("custom"))
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sort_array(F.collect_set("role")).alias("roles"))
    region = F.transform("roles", lambda r, i: F.struct(i.cast("int").alias("region_pos"), F.concat(F.lit("r_"), r).alias("region_id"), F.array().cast("array<string>").alias("parent_ids"), F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(1)), F.array(F.lit(0), F.lit(1))).alias("coords")))
    lines = F.transform("lines", lambda x: x.withField("region_ids", F.transform(x["region_ids"], lambda r: F.concat(F.lit("r_"), r))))
    return rows.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(".png")).alias("image_filename"), F.lit(5000).alias("image_width"), F.lit(5000).alias("image_height"), region.alias("regions"), lines.alias("lines"))


def _parsed(spark, d):
    return pagexml.emitted(_pages(spark, d), "conv_id").select("conv_id", pagexml.parsed(F.col("xml"), True).alias("p")).select("conv_id", "p.*")


@query(r"SELECT conv_id, 'l' || turn AS line_id, 'r_' || role AS region_id, text FROM conversations WHERE regexp_matches(text, '\S')")
def xml_roundtrip(spark, d):
    return pagexml.lines(_parsed(spark, d), "conv_id").select("conv_id", "line_id", F.col("region_ids")[0].alias("region_id"), "text")


@query(r"SELECT conv_id, 'r_' || role AS region_id, 0 AS l, LEAST(0, CAST(min(turn) * 20 AS INT)) AS t, greatest(1, CAST(max(length(text)) AS INT)) AS r, CAST(max(turn) * 20 + 20 AS INT) AS b FROM conversations WHERE regexp_matches(text, '\S') GROUP BY conv_id, role")
def region_boxes(spark, d):
    rows = pagexml.regions(_parsed(spark, d), "conv_id")
    return rows.withColumn("b_", nested.corner_box(F.col("coords"))).select("conv_id", "region_id", "b_.*")


@query(r"""SELECT conv_id || '-r_' || role || '-l' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) AS sample_id, CAST(length(text) + 1 AS INT) AS width, 21 AS height, CAST(turn * 20 AS INT) AS top, text AS transcription
FROM conversations WHERE regexp_matches(text, '\S')""")
def compile_lines(spark, d):
    pages = _parsed(spark, d).withColumn("page_id", F.col("conv_id").cast("string"))
    return jobs.compile_lines(pages).select("sample_id", "width", "height", F.col("coords")[0][1].alias("top"), "transcription")


@query("SELECT conv_id, role AS region_id, string_agg(text, '|' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id, role")
def sink_lines(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_pos"), F.array("role").alias("region_ids"), "text")
    return layout.sink(rows, "conv_id").select("conv_id", "region_id", F.array_join(F.transform("lines", lambda x: x["text"]), "|").alias("texts"))


@query("SELECT conv_id, turn AS line_pos, role AS region_id, text FROM conversations")
def lift_lines(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_pos"), F.array("role").alias("region_ids"), "text")
    return layout.lift(layout.sink(rows, "conv_id"), "conv_id").select("conv_id", "line_pos", F.col("region_ids")[0].alias("region_id"), "text")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '> ' || text END AS text FROM conversations")
def inject_htr(spark, d):
    rows = _table(spark, d, "conversations").withColumn("line_id", F.concat("role", F.col("turn").cast("string")))
    source = rows.withColumn("text", F.when(F.col("role") != "user", F.concat(F.lit("> "), "text")))
    return layout.injected(rows, source, ["conv_id", "turn"]).select("conv_id", "turn", "text")


POINTS_SQL = "SELECT l_orderkey, l_linenumber AS x, CAST(floor(l_quantity) AS INT) AS y FROM lineitem"


def _polygons(spark, d):
    rows = _table(spark, d, "lineitem").select("l_orderkey", F.array(F.col("l_linenumber"), F.floor("l_quantity").cast("int")).alias("p"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("coords"))


@query(f"SELECT l_orderkey, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM ({POINTS_SQL}) GROUP BY l_orderkey HAVING min(x) <> max(x) AND min(y) <> max(y)")
def bbox(spark, d):
    rows = _polygons(spark, d).select("l_orderkey", nested.box(F.col("coords")).alias("box"))
    return rows.filter(nested.has_area(F.col("box"))).select("l_orderkey", "box.*")


@query(f"WITH p AS ({POINTS_SQL}), m AS (SELECT l_orderkey, min(x) AS l, min(y) AS t FROM p GROUP BY l_orderkey) SELECT l_orderkey, string_agg((x - l) || ',' || (y - t), ' ' ORDER BY x, y) AS points FROM p JOIN m USING (l_orderkey) GROUP BY l_orderkey")
def shift_coords(spark, d):
    rows = _polygons(spark, d).withColumn("box", nested.box(F.col("coords")))
    return rows.select("l_orderkey", nested.point_text(nested.shifted(F.col("coords"), F.col("box.l"), F.col("box.t"))).alias("points"))


@query(f"""WITH p AS ({POINTS_SQL}) SELECT l_orderkey, least(1, min(x)) AS l, least(10, min(y)) AS t, greatest(2, max(x)) AS r, greatest(20, max(y)) AS b FROM p GROUP BY l_orderkey""")
def extend_box(spark, d):
    rows = _polygons(spark, d).withColumn("region_ids", F.array(F.lit("r0")))
    own = rows.select("l_orderkey", F.lit("r0").alias("region_id"), F.lit(1).alias("l"), F.lit(10).alias("t"), F.lit(2).alias("r"), F.lit(20).alias("b"))
    return layout.extended(own, rows, "l_orderkey").select("l_orderkey", "l", "t", "r", "b")


@query(f"""WITH b AS (SELECT l_orderkey, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM ({POINTS_SQL}) GROUP BY l_orderkey),
g AS (SELECT i AS col, j AS row, i * 4 AS ol, j * 25 AS ot FROM range(0, 3) a(i), range(0, 4) c(j))
SELECT col, row, count(*) AS n FROM b JOIN g ON l >= ol AND r <= ol + 4 AND t >= ot AND b <= ot + 25 AND l < ol + 4 AND t < ot + 25 GROUP BY col, row""")
def contained_in(spark, d):
    boxes = _polygons(spark, d).select(nested.box(F.col("coords")).alias("b")).select("b.*")
    return layout.in_grid(boxes, F.lit(4), F.lit(25)).groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS ({POINTS_SQL}), b AS (SELECT l_orderkey, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM p GROUP BY l_orderkey),
k AS (SELECT l_orderkey, l_linenumber AS n, CAST(floor(l_quantity) AS INT) AS q FROM lineitem)
SELECT l_orderkey, n, q FROM k JOIN b USING (l_orderkey) WHERE n >= l AND n <= r AND q >= t AND q <= b AND q + 5 <= b""")
def contained_lines(spark, d):
    boxes = _polygons(spark, d).select("l_orderkey", nested.box(F.col("coords")).alias("o")).select("l_orderkey", F.col("o.l").alias("ol"), F.col("o.t").alias("ot"), F.col("o.r").alias("or_"), F.col("o.b").alias("ob"))
    inner = _table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.floor("l_quantity").cast("int").alias("q")).select("*", F.col("n").alias("l"), F.col("n").alias("r"), F.col("q").alias("t"), (F.col("q") + 5).alias("b"))
    return layout.contained(inner, boxes, ["l_orderkey"]).select("l_orderkey", "n", "q")


CLASSES = ["N", "R", "A"]


@query("SELECT l_orderkey, l_linenumber AS n, l_returnflag AS name FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def layout_crops(spark, d):
    names = F.array(*map(F.lit, CLASSES))
    each = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), (F.array_position(names, F.col("l_returnflag")) - 1).cast("int").alias("cls"))))
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(each.alias("x"))
    rows = rows.select("l_orderkey", F.transform("x", lambda v: F.array(v["n"])).alias("rect_LTRB"), F.transform("x", lambda v: v["cls"]).alias("rect_classes"), names.alias("class_names"))
    return layout.crops(rows, ["R", "A"], "l_orderkey").select("l_orderkey", F.col("box")[0].alias("n"), "name")


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_returnflag = 'N') AS has_n, CAST(NULL AS BOOLEAN) AS has_other FROM lineitem GROUP BY l_orderkey")
def layout_classes(spark, d):
    names = F.array(*map(F.lit, CLASSES))
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.array_position(names, F.col("l_returnflag")) - 1).cast("int")).alias("c"))
    rows = rows.select("l_orderkey", nested.has_classes(F.col("c"), names, ["R", "N", "other"]).alias("h"))
    return rows.select("l_orderkey", F.col("h")[0].alias("has_r"), F.col("h")[1].alias("has_n"), F.col("h")[2].alias("has_other"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber + 2) * (CAST(floor(l_quantity) AS INT) + 1) AS area FROM lineitem")
def mask_areas(spark, d):
    """Pixels of rectangular polygons."""
    w, h = F.col("l_linenumber") + 2, F.floor("l_quantity").cast("int") + 1
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"))
    points = F.array(F.array(F.lit(0), F.lit(0)), F.array("w", F.lit(0)), F.array("w", "h"), F.array(F.lit(0), F.col("h")))
    return rows.select("l_orderkey", "l_linenumber", raster.area(points, F.lit(60), F.lit(12)).cast("int").alias("area"))


@query("""
WITH p AS (SELECT l_orderkey, unnest(range(l_linenumber, least(l_linenumber + 3, 9))) AS x, CAST(floor(l_quantity) AS INT) AS q FROM lineitem),
c AS (SELECT l_orderkey, x, y, count(*) AS n FROM (SELECT l_orderkey, x, unnest(range(q // 2, q + 1)) AS y FROM p) GROUP BY ALL)
SELECT l_orderkey, count(*) AS covered, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY l_orderkey""")
def page_cover(spark, d):
    """Overlapping rectangles on pages of 9 by 60 pixels, summed by tiles of 8 by 8."""
    x, q = F.col("l_linenumber"), F.floor("l_quantity").cast("int")
    top = (q / 2).cast("int")
    points = F.array(F.array(x, top), F.array(x + 3, top), F.array(x + 3, q + 1), F.array(x, q + 1))
    return raster.page_cover(_table(spark, d, "lineitem").select("l_orderkey", points.alias("coords")), ["l_orderkey"], "coords", 60, 9, 8)


@query("SELECT l_orderkey, l_linenumber, 128 AS height, CAST(least(2048, floor((l_linenumber * 40) * 128 / CAST(floor(l_quantity) AS INT))) AS INT) AS width FROM lineitem")
def target_dims(spark, d):
    size = raster.target_size(F.floor("l_quantity").cast("int"), F.col("l_linenumber") * 40, 128, 2048)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


# samples, joins, reports


@query("""
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER () AS n FROM documents),
a AS (SELECT doc_id, k <= CAST(floor(n * 0.8 + 1e-9) AS BIGINT) AS rest FROM h),
b AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM a WHERE rest)
SELECT doc_id, CASE WHEN k <= CAST(floor(n * 0.8 + 1e-9) AS BIGINT) THEN 'train' ELSE 'validation' END AS part FROM b UNION ALL SELECT doc_id, 'test' FROM a WHERE NOT rest""")
def split_train_val_test(spark, d):
    return sampling.train_validation_test(_table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "part")


@query("""
SELECT 'labelled' AS kind, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id)
UNION ALL SELECT 'unlabelled', count(*) FROM documents ANTI JOIN labels USING (doc_id)
UNION ALL SELECT 'with_quality', count(quality) FROM documents LEFT JOIN labels USING (doc_id)""")
def labelled_lines(spark, d):
    docs, labels = _table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels")
    one = lambda k, n: n.select(F.lit(k).alias("kind"), "n")
    count = lambda x: x.agg(F.count(F.lit(1)).alias("n"))
    return one("labelled", count(docs.join(labels, "doc_id", "left_semi"))).unionByName(one("unlabelled", count(tables.not_done(docs, labels, ["doc_id"])))).unionByName(one("with_quality", docs.join(labels, "doc_id", "left").agg(F.count("quality").alias("n"))))


@query("SELECT conv_id, turn, text, '(' || turn || ',' || length(role) || ')' AS masks FROM conversations WHERE text <> '' UNION ALL SELECT conv_id, turn, '<[(' || turn || ',' || length(role) || ')]>', '' FROM conversations WHERE text = ''")
def mask_syntax(spark, d):
    t = _table(spark, d, "conversations")
    written = tables.join_masks(F.col("text"), F.array(F.struct(F.col("turn").cast("int").alias("off"), F.length("role").alias("len"))))
    rows = t.select("conv_id", "turn", tables.split_masks(written).alias("m"))
    pairs = F.array_join(F.transform("m.masks", lambda m: F.format_string("(%d,%d)", m["off"], m["len"])), " ")
    return rows.select("conv_id", "turn", "m.text", pairs.alias("masks"))


@query("SELECT conv_id, turn, role AS name, '> ' || text AS text, text AS gt FROM conversations")
def prediction_merge(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"), "text")
    pred = rows.select("conv_id", "turn", F.concat(F.lit("> "), "text").alias("prediction"))
    return layout.with_predictions(rows, pred, ["conv_id", "turn"]).select("conv_id", "turn", "name", "text", "gt")


@query("""
WITH c AS (SELECT conv_id, turn, md5(text) AS m FROM conversations)
SELECT conv_id, md5(string_agg(m, '' ORDER BY turn)) AS md5 FROM c GROUP BY conv_id""")
def tree_md5(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("md5"))
    return tables.tree_checksum(rows, ["conv_id"], "turn")


@query("SELECT DISTINCT url AS img_path, regexp_replace(url, '/([^/]*)$', '/\\1') || '.lines.json' AS layout_path, url || '.htr.json' AS output_path FROM pages")
def work_list(spark, d):
    pages = _table(spark, d, "pages").select(F.concat("url", F.lit(".img.png")).alias("path"))
    out = tables.work_list(pages, ".img.png", ".lines.json", ".htr.json")
    return out.select(tables.with_suffix(F.col("img_path"), ".img.png", "").alias("img_path"), "layout_path", "output_path")


@query("""
SELECT user_id, event_id, value, min(value) OVER w AS best_value, first_value(event_id) OVER (PARTITION BY user_id, b ORDER BY event_id) AS best_epoch
FROM (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def best_so_far(spark, d):
    log = _table(spark, d, "events").select("user_id", "event_id", "value")
    return metrics.epochs(log, ["user_id"], "event_id", "value").select("user_id", "event_id", "value", "best_value", "best_epoch")


@query("SELECT l_orderkey, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY k, v) AS flat FROM (SELECT l_orderkey, unnest([l_linenumber, CAST(floor(l_quantity) AS INT)]) AS v, min(least(l_linenumber, CAST(floor(l_quantity) AS INT))) OVER (PARTITION BY l_orderkey) * 0 AS k FROM lineitem) GROUP BY l_orderkey")
def flatten_lists(spark, d):
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_linenumber"), F.floor("l_quantity").cast("int"))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.array_sort(nested.flattened(nested.deep_sorted(F.col("x")))).cast("array<string>"), " ").alias("flat"))


@query("WITH x AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT max(n) AS m FROM x) SELECT user_id, n, m AS width FROM x, m")
def pad_scores(spark, d):
    rows = _table(spark, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    width = rows.agg(F.max(F.size("v"))).scalar()
    return rows.select("user_id", F.size("v").cast("long").alias("n"), F.size(nested.padded(F.col("v"), width, 0.0)).cast("long").alias("width"))


#: A specification for each part: s is its size, k its key.
SPEC = "[1,{16s},0,1 Cr3,3,{8k} Mp2,2 ([Cl3,3,8 Gn4] [Rn6 A3,5]) Cr5,3,24,2,1 Do0.3,2 Mp4,1 S1(1x0)1,3 Lbx{s10} O1c{3s} I]"


#: The shapes are worked out by hand from the rules of the blocks.
@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), b AS (SELECT k, s, 1 + k % 5 AS f, unnest(range(13)) AS i FROM p)
SELECT k AS p_partkey, CAST(i AS INT) AS idx,
 ['Cr3,3,' || f * 8, 'Mp2,2', 'Cl3,3,8', 'Gn4', 'Rn6', 'A3,5', 'Cr5,3,24,2,1', 'Do0.3,2', 'Mp4,1', 'S1(1x0)1,3', 'Lbx' || s + 10, 'O1c' || s * 3, 'I'][i + 1] AS block,
 ['conv', 'maxpool', 'conv', 'groupnorm', 'residual', 'addition', 'conv', 'dropout', 'maxpool', 'reshape', 'recurrent', 'output', 'identity'][i + 1] AS op,
 CAST(CASE WHEN i BETWEEN 2 AND 5 THEN 2 ELSE 0 END AS INT) AS depth, 1 AS n,
 CAST([f * 8, f * 8, 8, 8, 6, 5, 24, 24, 24, 24 * s, 2 * s + 20, 3 * s, 3 * s][i + 1] AS INT) AS c, CAST([16 * s, 8 * s, 8 * s, 8 * s, 8 * s, 8 * s, 4 * s, 4 * s, s, 1, 1, 1, 1][i + 1] AS INT) AS h, 0 AS w FROM b""")
def vgsl_shapes(spark, d):
    """Shapes of a specification for each part, made from its size and key."""
    s, f = F.col("p_size"), F.col("p_partkey") % 5 + 1
    spec = F.lit(SPEC)
    for name, value in (("{16s}", s * 16), ("{8k}", f * 8), ("{s10}", s + 10), ("{3s}", s * 3)):
        spec = F.replace(spec, F.lit(name), value.cast("string"))
    rows = profile.spread(_table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", F.explode(network_spec.shapes(spec)).alias("b"))
    return rows.select("p_partkey", "b.*")


@query(f"""WITH m AS (SELECT {_CODES_SQL} AS m), t AS (SELECT conv_id, turn, CASE WHEN text = '' THEN [] ELSE string_split(text, '') END AS s FROM conversations),
c AS (SELECT conv_id, turn, list_transform(s, lambda x: coalesce(m[x], 1)) AS codes, max(len(s)) OVER (PARTITION BY conv_id) AS width FROM t, m)
SELECT conv_id, turn, CAST(len(codes) AS INT) AS length, CAST(width AS INT) AS width, array_to_string(codes || list_transform(range(width - len(codes)), lambda i: 0), ' ') AS codes FROM c""")
def encode_batches(spark, d):
    """Codes of each conversation's turns as one batch, filled with null codes up to the longest turn."""
    out = LETTERS.encode_batch(_table(spark, d, "conversations"), "text", ["conv_id"], normal=False)
    return out.select("conv_id", "turn", "length", F.size("codes").alias("width"), F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch, value / 100 AS cer, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT *, least(1.0, min(cer) OVER w) AS best FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch)),
b AS (SELECT *, coalesce(max(CASE WHEN cer = best THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch), -1) AS best_epoch FROM m),
s AS (SELECT *, min(CASE WHEN epoch - best_epoch > 12 THEN epoch END) OVER (PARTITION BY user_id) AS last FROM b)
SELECT user_id, epoch, round(best, 9) AS best_cer, best_epoch, round(0.001 * pow(0.1, CAST(epoch >= floor(n * 0.5) AS INT) + CAST(epoch >= floor(n * 0.75) AS INT)), 9) AS lr, last IS NULL OR epoch <= last AS ran FROM s""")
def training_runs(spark, d):
    """Events of each user as the epochs of a training run: learning rate, best epoch and early end."""
    log = ranking.numbered(_table(spark, d, "events"), "k", "event_id", by=["user_id"]).select("user_id", (F.col("k") - 1).alias("epoch"), (F.col("value") / 100).alias("cer"))
    out = metrics.training(log, ["user_id"], patience=12)
    return out.select("user_id", "epoch", F.round("best_cer", 9).alias("best_cer"), "best_epoch", F.round("lr", 9).alias("lr"), "ran")


@query("SELECT CAST(user_id % 7 AS INT) AS epoch, count(*) AS n, round(avg(value), 6) AS loss FROM events GROUP BY user_id % 7")
def epoch_losses(spark, d):
    """Mean loss of each epoch; events stand for batches, their users for epochs."""
    log = _table(spark, d, "events").select((F.col("user_id") % 7).cast("int").alias("epoch"), F.col("value").alias("loss"))
    return metrics.epoch_losses(log).select("epoch", "n", _round(F.col("loss")).alias("loss"))
