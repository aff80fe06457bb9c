from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import decoding, metrics, profile
from vellum.operators.alphabet import Alphabet
from vellum.plans import jobs
from vellum.plans import network_spec as spec
from vellum.sources import tables
from vellum.streaming import labels as stream


def collapse(path):
    return tuple(k for k, _ in itertools.groupby(path) if k)


def test_beam_finds_the_most_probable_text():
    rng = np.random.default_rng(1)
    for _ in range(10):
        p = rng.dirichlet(np.ones(3), 5)
        total: dict = {}
        for path in itertools.product(range(3), repeat=5):
            total[collapse(path)] = total.get(collapse(path), 0) + np.prod([p[t, s] for t, s in enumerate(path)])
        best = max(total, key=total.get)
        got, log_p = decoding.beam(p, 1000)
        assert tuple(got) == best and log_p == pytest.approx(np.log(total[best]))
    double = np.array([[0.05, 0.95], [0.95, 0.05], [0.05, 0.95]])
    assert decoding.beam(double)[0] == [1, 1]


def frames(spark):
    scores = [[0, 1, 5], [0, 9, 5], [1, 0, 0], [0, 3, 1], [0, 4, 1], [0, 1, 7], [0, 2, 2]]
    return spark.createDataFrame([(1, t, [float(x) for x in s]) for t, s in enumerate(scores)], "seq int, t int, logits array<float>")


def plain_beam(probabilities, width):
    """Prefixes as tuples in a dictionary."""
    beams = {(): (0.0, -np.inf)}
    for frame in np.log(probabilities):
        found = {}
        add = lambda prefix, k, v, found=found: found.setdefault(prefix, [-np.inf, -np.inf]).__setitem__(k, np.logaddexp(found[prefix][k], v))
        for prefix, (blank, label) in beams.items():
            add(prefix, 0, np.logaddexp(blank, label) + frame[0])
            if prefix:
                add(prefix, 1, label + frame[prefix[-1]])
            for s in range(1, len(frame)):
                add((*prefix, s), 1, (blank if prefix[-1:] == (s,) else np.logaddexp(blank, label)) + frame[s])
        beams = dict(sorted(found.items(), key=lambda x: (-np.logaddexp(*x[1]), x[0]))[:width])
    prefix, two = next(iter(beams.items()))
    return list(prefix), float(np.logaddexp(*two))


@pytest.mark.parametrize("prune", [3, 4096])
def test_beams_on_a_trie(spark, monkeypatch, prune):
    """Against plain prefixes, with the trie pruned all the time or never, and over batches of three frames."""
    monkeypatch.setattr(decoding.Beams, "PRUNE", prune)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        x = rng.random((rng.integers(0, 25), rng.integers(2, 6))) + 0.01
        x = np.round(x * 2) / 2 + 0.5 if seed % 3 == 0 else x  # ties
        for width in (1, 3, 20):
            labels, p = decoding.beam(x, width)
            want, q = plain_beam(x, width)
            assert labels == want and p == pytest.approx(q)
    beams = decoding.Beams(3)
    for frame in np.log(np.random.default_rng(1).random((3000, 12)) ** 9):
        beams.frame(frame)
    labels, _ = beams.result()
    assert len(labels) > 1000 and len(beams.parent) <= 3 * prune + 9 * len(labels)
    rng = np.random.default_rng(7)
    rows = [(s, t, rng.normal(size=4).tolist()) for s, n in ((1, 40), (2, 1), (None, 17)) for t in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.s: r for r in decoding.beam_decoded(spark.createDataFrame(rows, "s int, t int, logits array<float>").repartition(3), ["s"], "t").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in (1, 2, None):
        e = np.exp(np.array([v for k, _, v in rows if k == s], np.float32).astype(float))
        want, q = plain_beam(e / e.sum(axis=1, keepdims=True), 3)
        assert got[s].labels == want and got[s].log_p == pytest.approx(q, abs=1e-5)


def test_greedy_and_scores(spark):
    f = decoding.greedy_frames(frames(spark), ["seq", "t"])
    assert [r.label for r in f.orderBy("t").collect()] == [2, 1, 0, 1, 1, 2, 1]
    assert [(r.label, r.score) for r in decoding.ctc_scores(f, ["seq"], "t").orderBy("run").collect()] == [(2, 5.0), (1, 9.0), (1, 4.0), (2, 7.0), (1, 2.0)]
    assert decoding.ctc_labels(f, ["seq"], "t").first().labels == [2, 1, 1, 2, 1]


@pytest.mark.parametrize("rows", [None, 25])
def test_runs_of_long_sequences(spark, rows):
    """One sequence is cut into many cells (rows=25), with runs that go on across borders; others are not."""
    rng = random.Random(2)
    made = [(s, t, rng.choice([0, 1, 1, 2]), rng.random()) for s, n in (("long", 400), ("short", 9), (None, 60)) for t in range(n)]
    made += [("flat", t, 3, rng.random()) for t in range(200)] + [("gaps", t, rng.choice([None, 4]), 1.0) for t in range(120)]
    frames = spark.createDataFrame(made, "seq string, t int, label int, score double").repartition(4)
    want = {}
    for s in {m[0] for m in made}:
        run, before = 0, "none"
        for _, t, label, _ in sorted(m for m in made if m[0] == s):
            starts = before is None or label is None or label != before
            run += starts
            want[s, t] = (starts, run)
            before = label
    got = decoding.runs(frames, ["seq"], "t", rows=rows)
    assert {(r.seq, r.t): (r.starts, r.run) for r in got.collect()} == want and got.columns == [*frames.columns, "starts", "run"]
    scores = {}
    for s, t, label, score in made:
        if label:
            key = s, want[s, t][1], label
            scores[key] = max(scores.get(key, 0), score)
    assert {(r.seq, r.run, r.label): r.score for r in decoding.ctc_scores(frames, ["seq"], "t", rows=rows).collect()} == scores
    labels = {s: [x[2] for x in sorted(m for m in made if m[0] == s) if x[2] and want[s, x[1]][0]] for s in {m[0] for m in made}}
    assert {r.seq: r.labels for r in decoding.ctc_labels(frames, ["seq"], "t", rows=rows).collect()} == labels


def test_texts_of_frame_arrays(spark):
    rows = frames(spark).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "logits"))), lambda x: x["logits"]).alias("frames"))
    a = Alphabet({"ϵ": 0, "x": 1, "y": 2})
    r = decoding.predicted(rows, a).first()
    assert r.prediction == "yxxyx" and r.scores == [5.0, 9.0, 4.0, 7.0, 2.0]
    r = decoding.predicted(rows.withColumn("n", F.lit(3)), a, length="n").first()
    assert r.prediction == "yx" and r.scores == [5.0, 9.0]
    got = decoding.beam_decoded(frames(spark), ["seq"], "t", width=10).first()
    assert got.seq == 1 and got.labels[0] == 2


def test_half(spark):
    assert spark.range(1).select(decoding.half(F.array(*map(F.lit, (1, 2, 3, 4))))).first()[0] == [1, 2]
    with pytest.raises(Exception, match="odd"):
        spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(decoding.half(F.col("x"))).collect()


def test_stream_of_labels(spark, tmp_path):
    rows = [(u, t, t * u // 3 % 3) for u in (1, 2) for t in range(30)]
    spark.createDataFrame(rows, "u long, t long, label int").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("u long, t long, label int").parquet(str(tmp_path / "in"))
    q = stream.collapsed(source, "u", "t").writeStream.format("memory").queryName("collapsed").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select * from collapsed").collect())
    want = sorted((u, t, x) for u in (1, 2) for (_, t, x), b in zip([r for r in rows if r[0] == u], [None, *(r[2] for r in rows if r[0] == u)], strict=False) if x and x != b)
    assert got == want


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("[ 2,60,80,1  Rn12 ]", (2, 12, 60, 80)),
        # halved by each pool: 64 -> 32 -> 16 high, 200 -> 100 -> 50 wide
        ("[3,64,200,3 Cr5,5,10 Mp2,2 Rn20 Mp2,2 Rn40 Rn40]", (3, 40, 16, 50)),
        # 16 and 24 channels side by side at half the size, then 30 rows folded into 40 * 30 channels, then two directions of 11
        (" [ 1,60,90,3 ( [  Cr3,3,16 Do0.2,2  Mp2,2]   [ Cl3,3,24 Mp2,2] )  S1( 1x0)1,3 Lbx11 O1c9  ] ", (1, 9, 1, 45)),
        ("[0,0,0,5 (Cl3,3,6 Cl3,3,7)]", (0, 13, 0, 0)),
        ("[0,0,0,12 A3,4]", (0, 4, 0, 0)),
        ("[1,30,0,1 Lfys8 Gbx{last}9]", (1, 18, 1, 0)),
        ("[1,6,7,1 CTr2,2,3,2,2]", (1, 3, 12, 14)),
        ("[1,2,4,8]", (1, 8, 2, 4)),
    ],
)
def test_shapes(text, out):
    shape = spec.parse(text)[2]
    assert (shape.n, shape.c, shape.h, shape.w) == out


@pytest.mark.parametrize("text", ["1,2,3,4", "[1,2,3]", "[1,2,3,4 Qq]", "[1,2,3,4 (Rn3 Mp2,2)]", "[1,2,3,4 [Rn3]", "[1,2,3,4 O0l3]", "[1,2,3,4 O2c3]", "[1,5,3,4 S1(2x0)1,3]", "[1,2,3,4 A4,2]"])
def test_bad_specs(text):
    with pytest.raises(spec.SpecError):
        spec.parse(text)


def test_chunks():
    chunks = [("sizes", "1,{side},0,1"), ("pictures", "Cr3,3,8 Mp2,2"), ("rows away", "Mp{side//2},1"), ("lines", "Gbx{2*units}")]
    assert spec.from_chunks(chunks, side=40, units=6) == "[1,40,0,1 Cr3,3,8 Mp2,2 Mp20,1 Gbx12]"
    with pytest.raises(spec.SpecError):
        spec.from_chunks([("x", "Mp{__import__('os')},1")], height=1)
    assert spec.with_output("[0,8,0,1 Gbx5]", 7) == "[0,8,0,1 Gbx5 O1c7]"


def test_spec_rows(spark):
    rows = spark.createDataFrame([("[0,8,8,3 Mp2,2 Rn4]",), ("bad",)], "s string").select(spec.shapes(F.col("s")).alias("x")).collect()
    assert [tuple(b) for b in rows[0].x] == [(0, "Mp2,2", "maxpool", 0, 0, 3, 4, 4), (1, "Rn4", "residual", 0, 0, 4, 4, 4)] and rows[1].x is None


def test_names_and_heads_of_specifications():
    net = "[1,40,0,1 Cr{first}3,3,16 Mp2,2 S1(1x0)1,3 Lbx24 O1c30]"
    assert spec.names(net) == ["first", "Mp_1", "S_2", "Lbx_3", "O_4"]
    assert spec.resized_output(net, 7) == net.replace("O1c30", "O1c7")
    assert spec.parse(spec.resized_output(net, 7))[2].c == 7
    bare = net.replace(" O1c30", "")
    assert spec.appended(bare, "O1c30") == net
    with pytest.raises(spec.SpecError, match="output"):
        spec.resized_output(bare, 7)
    with pytest.raises(spec.SpecError):
        spec.appended(bare, "Zz9")


def test_logs_counts_and_summaries(spark, tmp_path):
    a = Alphabet({"ϵ": 0, "x": 1, "y": 2})
    rows = spark.createDataFrame([("b", "xy", "x\u00e9"), ("a", "y", "y"), ("c", "x", None), ("a2", None, "yy")], "id string, prediction string, gt string")
    reduced = {r.gt: r.r for r in rows.select("gt", a.reduce(F.col("gt")).alias("r")).collect()}
    assert [tuple(r) for r in jobs.sample_log(rows, a, 3).collect()] == [("a", "y", reduced["y"], "y"), ("a2", None, reduced["yy"], "yy"), ("b", "xy", reduced["x\u00e9"], "x\u00e9")]
    assert jobs.sample_log(rows.limit(0), a, 3).count() == 0
    assert tuple(jobs.compiled_counts(rows.withColumn("page_id", F.substring("id", 1, 1))).first()) == (4, 3)
    assert profile.summary(rows, "lines") == "lines: 4 rows\n  id: string, 4 values\n  prediction: string, 3 values\n  gt: string, 3 values"
    found = metrics.confusions(rows.select(F.coalesce("prediction", F.lit("")).alias("pred"), F.coalesce("gt", F.lit("")).alias("gt")))
    tables.write_confusions(found, f"{tmp_path}/confusions")
    back = spark.read.parquet(f"{tmp_path}/confusions")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, found.collect()))


def test_another_decoder(spark):
    """The second best class of each frame, for want of a better idea."""
    a = Alphabet.from_classes(["a", "b"])
    rows = spark.createDataFrame([([[0.1, 0.0, 0.5, 0.4], [0.1, 0.0, 0.3, 0.9], [0.9, 0.8, 0.0, 0.0]],)], "frames array<array<double>>")

    def second(frames, length):
        score = lambda f: F.get(F.sort_array(f, asc=False), F.lit(1))
        return F.transform(frames, lambda f: F.struct((F.array_position(f, score(f)) - 1).cast("int").alias("label"), score(f).alias("score")))

    r = jobs.decode(rows, a, decoder=second).first()
    assert (r.prediction, r.scores) == ("ba?", [0.4, 0.3, 0.8])


def test_equal_specifications_of_a_batch_are_parsed_once(monkeypatch):
    import pyarrow as pa

    seen, parse = [], spec.parse
    monkeypatch.setattr(spec, "parse", lambda s: seen.append(s) or parse(s))
    text = "[1,48,0,1 Cr3,3,8]"
    out = spec.shapes.func(pa.array([text, "no", text, None, text])).to_pylist()
    assert [len(r) if r else r for r in out] == [1, None, 1, None, 1] and seen == [text, "no"]
