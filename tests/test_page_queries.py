"""The queries over pages and line images on small tables with nulls, blanks and odd characters."""

from __future__ import annotations

import re

import pytest

from vellum.plans import page_queries
from vellum.plans.page_queries import COMPOUND, COMPOUNDS, FOLDED
from vellum.plans.queries import QUERIES

TEXTS = ["the ringing nation\nquä..ours", "", None, "SCHösch ing\ttion…", "...", "t h e", "😀one\n\nhe"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    turns = [(1, 0, "user", "a line"), (1, 1, "assistant", "  "), (1, 2, "user", "<b> & \"c\""), (2, 0, "system", ""), (3, 0, "user", "ü"), (3, 1, "system", "x\u2003y")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, 1), (2, 50), (3, 9)], "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    return d


def rows(spark, folder, name):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def longest_first(text):
    """Codes found by hand: at each place the longest symbol that begins there."""
    out, k = [], 0
    while k < len(text):
        s = max((x for x in COMPOUND if text.startswith(x, k)), key=len, default=text[k])
        out.append(COMPOUNDS.codes.get(s, 1))
        k += len(s)
    return out


def test_compound_symbols(spark, folder):
    import hashlib

    got = {r[0]: r[1:] for r in rows(spark, folder, "compound_codes")}
    for k, t in enumerate(TEXTS):
        codes = longest_first(t) if t is not None else None
        assert got[k] == ((len(codes), hashlib.md5(" ".join(map(str, codes)).encode()).hexdigest()) if codes is not None else (None, None))


def test_case_folding(spark, folder):
    import hashlib

    got = dict(rows(spark, folder, "folded_text"))
    for k, t in enumerate(TEXTS):
        want = re.sub(r"[^a-z0-9 .,\-]", "?", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if t is not None else None
        assert got[k] == (hashlib.md5(want.encode()).hexdigest() if want is not None else None)
    assert FOLDED.get_code("Q") == FOLDED.get_code("q") and FOLDED.get_symbol(FOLDED.get_code("Q")) == "q"


def test_pages_survive_json(spark, folder):
    want = [(1, "l0", "r_user", "a line", 15), (1, "l2", "r_user", "<b> & \"c\"", 55), (3, "l0", "r_user", "ü", 15), (3, "l1", "r_system", "x\u2003y", 35)]
    assert sorted(rows(spark, folder, "json_roundtrip")) == want
    assert sorted(rows(spark, folder, "owned_regions")) == [(1, "r_user"), (3, "r_system"), (3, "r_user")]
    assert rows(spark, folder, "compiled_counts") == [(4, 2)]


def test_region_documents(spark, folder):
    got = sorted(rows(spark, folder, "region_documents"))
    assert [r[:5] for r in got] == [(1, "r_user", 13, 17, 2), (3, "r_system", 13, 17, 1), (3, "r_user", 13, 17, 1)]
    assert got[0][5] == "l0:7:a line|l2:47:<b> & \"c\""


def test_sizes_of_pages(spark, folder):
    got = {r[0]: r[1:] for r in rows(spark, folder, "page_sizes")}
    assert got[0] == (36, "kept") and got[1] == (0, "kept") and 2 not in got
    assert len(page_queries._LONGEST.split("|")) == len(COMPOUND)


def test_line_images(spark, folder):
    assert {r[0]: r[1:] for r in rows(spark, folder, "line_images")} == {k: (w * h, w - 1, h - 1, w * h, w * h, 16 * h, w * h, w * h) for k, w, h in ((1, 3, 1), (2, 7, 50), (3, 2, 9))}


def test_line_images_pass_through_no_columns(spark, folder):
    """One Python process a task, given polygons and boxes: it was five, with batches of whole images between them."""
    plan = QUERIES["line_images"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "binary" not in plan


def test_reports(spark, folder):
    log = rows(spark, folder, "sample_log")
    assert [r[0] for r in log] == ["1-0000", "1-0001", "1-0002", "2-0000", "3-0000", "3-0001"]
    assert log[0][1:] == ("a lime".replace("n", "m"), "a line", "a line")
    roles = {r[0]: r[1:3] for r in rows(spark, folder, "evaluated_roles")}
    assert roles["user"] == (3, 0) and roles["system"] == (1, 1)


def test_decoding_up_to_a_length(spark, folder):
    got = {(r[0], r[1]): r[2] for r in rows(spark, folder, "decoded_lengths")}
    assert got[(1, 0)] == "a " and got[(1, 1)] == "  " and got[(2, 0)] == "" and got[(3, 1)] == "x?y"  # an em space is no symbol
    assert got[(1, 2)][1] == "b" and len(got[(1, 2)]) == 4 and len(got[(3, 0)]) == 1
    assert all(len(v) <= t + 2 for (_, t), v in got.items())


def test_stamped_pages(spark, folder):
    assert sorted(rows(spark, folder, "stamped_pages")) == [(1, "reviewed", "2024-05-01", 2, 0), (3, "reviewed", "2024-05-01", 2, 0)]


def test_prediction_report(spark, folder):
    got = {r[0]: r[1:] for r in rows(spark, folder, "prediction_report")}
    assert got["1-0"] == ("a lime".replace("u", ""), "a line", "0.5 4.25", "user") and got["2-0"][1] == ""


def test_line_samples(spark, folder, tmp_path):
    docs = [(1, "web", "a line \n"), (2, None, ""), (3, "book", "x")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0.5), (1, 0.7)], "doc_id long, quality double").write.parquet(f"{tmp_path}/labels.parquet")
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = sorted(rows(spark, str(tmp_path), "line_samples"))
    assert got == [("1", 5, md5("a line"), True), ("2", 1, md5(""), False), ("3", 6, md5("x"), False)]
