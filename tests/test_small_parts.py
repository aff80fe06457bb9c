"""Operators that no query shows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vellum.functions import nested
from vellum.operators import alphabet as alpha
from vellum.operators import layout, metrics, sampling
from vellum.operators.alphabet import Alphabet
from vellum.plans import jobs, network_spec
from vellum.sources import tables


def test_alphabet_files(spark, tmp_path):
    a = Alphabet.from_classes(["x", ["A", "a"], "\"", "ü", " "])
    tables.write_alphabet(a.table(spark), f"{tmp_path}/a")
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    rows = [line.split("\t") for line in text.split("\n") if line]
    assert {s: int(c) for s, c in rows} == a.codes and [s for s, _ in rows] == sorted(a.codes)
    tables.write_alphabet(a.table(spark), f"{tmp_path}/a", mode="overwrite")
    with pytest.raises(Exception, match="exist"):
        tables.write_alphabet(a.table(spark), f"{tmp_path}/a")


def test_polygons_and_unzipped(spark):
    found = spark.createDataFrame([("p", 3, [[1, 2], [3, 4]], None)], "page_id string, line_pos int, coords array<array<int>>, text string")
    assert [tuple(r) for r in layout.polygons(found).collect()] == [("p", 3, [[1, 2], [3, 4]])]
    assert layout.polygons(found.withColumnRenamed("page_id", "k").withColumnRenamed("coords", "baseline"), "baseline", "k").columns == ["k", "line_pos", "polygon"]
    df = spark.createDataFrame([([(1, "a"), (2, None)],), ([],), (None,)], "x array<struct<i:int,s:string>>")
    got = df.select(nested.unzipped(F.col("x"), "s", "i").alias("u")).select("u.*").collect()
    assert [tuple(r) for r in got] == [(["a", None], [1, 2]), ([], []), (None, None)]


def test_reduced_codes():
    a = Alphabet.from_classes([["b", "B"], "c"])
    assert a.reduced_codes() == {"ϵ": 0, "?": 1, "B": 2, "c": 3}


def test_duration_estimate(spark):
    df = spark.createDataFrame([(1, 4, 10.0), (4, 4, 10.0), (0, 4, 0.0)], "done int, total int, s double")
    assert [r[0] for r in df.select(sampling.duration_estimate(F.col("done"), F.col("total"), F.col("s"))).collect()] == [30.0, 0.0, None]


def test_evaluate_reduces_the_ground_truth(spark):
    a = Alphabet.from_classes([["a", "A"], "b", "c", " "])
    rows = [("x", "Abc", "ABC"), ("x", "Ab", "ab c"), ("y", "?A", "za"), ("y", "", "")]
    df = spark.createDataFrame(rows, "page string, prediction string, gt string")
    # reduced: B and C are unknown; a is A, z is unknown
    got = {r.page: r for r in jobs.evaluate(df, a, ("page",)).collect()}
    assert (got["x"].n, got["x"].n_empty, got["y"].n, got["y"].n_empty) == (2, 0, 1, 1)
    assert got["x"].cer == pytest.approx((2 / 3 + 2 / 4) / 2) and got["x"].wer == pytest.approx((1 + 1 / 2) / 2) and got["x"].ler == 1
    assert (got["y"].cer, got["y"].wer, got["y"].ler) == (0, 0, 0)
    assert jobs.evaluate(df, a).first().cer_micro == pytest.approx(4 / 9)


def test_own_alphabets(spark):
    texts = ["", "banana", "ϵb", "é👍é a", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(alpha.own_codes(F.col("t")).alias("c"), alpha.own_codes(F.col("t"), "#").alias("d")).collect()
    for t, r in zip(texts, got, strict=True):
        for null, found in (("ϵ", r.c), ("#", r.d)):
            if t is None:
                assert found is None
            else:
                want = {null: 0} | {c: k for k, c in enumerate(sorted(set(t)), 1)}
                assert {x.symbol: x.code for x in found} == want


def plain_run(values, planned, patience, lr):
    best, best_at, ended, out = 1.0, -1, False, []
    for e, v in enumerate(values):
        if v is not None and v <= best:
            best, best_at = v, e
        out.append((e, best, best_at, lr * 0.1 ** sum(e >= math.floor(planned * p) for p in (0.5, 0.75)), not ended))
        ended = ended or e - best_at > patience
    return out


@pytest.mark.parametrize("rows", [None, 4])
def test_training_runs(spark, rows):
    logs = {"ties": [0.5, 0.4, 0.4, 0.6, 0.4, 0.7, 0.7, 0.7, 0.7, 0.1], "bad": [1.5, 1.2, None, 1.1, 1.3], "one": [1.0], None: [0.9, 0.8, 0.7, 0.6]}
    df = spark.createDataFrame([(g, e, v) for g, vs in logs.items() for e, v in enumerate(vs)], "run string, epoch int, cer double").repartition(3)
    got = {g: [] for g in logs}
    for r in metrics.training(df, ["run"], lr=0.01, patience=2, rows=rows).orderBy("epoch").collect():
        got[r.run].append((r.epoch, r.best_cer, r.best_epoch, pytest.approx(r.lr), r.ran))
    assert got == {g: plain_run(vs, len(vs), 2, 0.01) for g, vs in logs.items()}
    planned = metrics.training(df.filter("run = 'ties'"), ["run"], lr=0.01, patience=99, max_epoch=F.lit(6)).orderBy("epoch").collect()
    assert [round(r.lr, 6) for r in planned] == [0.01] * 3 + [0.001] + [0.0001] * 6


def test_metadata_of_specifications(spark):
    read = lambda new, old=None: spark.createDataFrame([(new, old)], "new string, old string").select(network_spec.metadata(F.col("new"), network_spec.metadata(F.col("old"))).alias("m")).first().m
    assert tuple(read(None)) == (None, None, None, {}, True)
    old = '{"one_channel_mode": "L", "model_type": "recognition", "hyper_params": {"lr": "0.1", "batch": "4"}, "legacy_polygons": false}'
    assert tuple(read('{"seg_type": "bbox", "hyper_params": {"lr": "0.2"}}', old)) == ("L", "recognition", "bbox", {"batch": "4", "lr": "0.2"}, False)
    assert read('{"legacy_polygons": true}', old).legacy_polygons is True
    for bad in ('{"one_channel_mode": "RGB"}', '{"model_type": "other"}', '{"seg_type": "lines"}'):
        with pytest.raises(Exception, match="is none of"):
            read(bad)
