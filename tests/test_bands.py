from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import bands, distance


def whole(pairs):
    """Counts of the paths themselves."""
    path = [(x, y, ops, *distance.places(ops)) for (x, y), ops in zip(pairs, distance.paths(pairs), strict=True)]
    return [int((x[i[ops == distance.BOTH]] == y[j[ops == distance.BOTH]]).sum()) for x, y, ops, i, j in path], [int((ops == distance.BOTH).sum()) for ops in distance.paths(pairs, common=True)]


def some_pairs(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        k, size = rng.choice([1, 2, 3, 9, 40]), lambda: rng.choice([0, 1, 2, 5, 30, 63, 64, 65, 129, 300, 700])  # noqa: B023
        x = [rng.randrange(k) for _ in range(size())]
        kind = rng.randrange(4)
        y = [rng.randrange(k + 1) for _ in range(size())] if kind == 0 else [v for v in x if rng.random() < 0.9] if kind == 1 else x[::-1] if kind == 2 else [w for v in x for w in ([v] if rng.random() < 0.8 else [v, v] if rng.random() < 0.5 else [rng.randrange(k + 1)])]
        x, y = (x, y) if rng.random() < 0.5 else (y, x)
        yield np.array(x, np.int64), np.array(y, np.int64)


@pytest.mark.parametrize("how", ["cheapest", "together", "alone", "alone in parts"])
def test_counts_are_those_of_the_paths(monkeypatch, how):
    if how != "cheapest":
        price = (0, 0, 0, 1e9, 0, 16) if how == "together" else (1e9, 0, 1e9, 0, 0, 16)
        monkeypatch.setattr(bands, "MATCHES", price)
        monkeypatch.setattr(bands, "COMMON", price)
    if how == "alone in parts":
        monkeypatch.setattr(bands, "RECORD", 0)
    pairs = list(some_pairs(8, 300))
    pairs += [(np.arange(4000) % 7, np.delete(np.arange(4000) % 7, slice(700, 1100)))]
    one, two = bands.counts(pairs)
    assert (one.tolist(), two.tolist()) == whole(pairs)


def test_counts_of_many_kinds_of_values():
    """More than a table has, and larger ones than a table is made for."""
    rng = np.random.default_rng(4)
    x = rng.permutation(3000)
    pairs = [(x, np.delete(x, slice(100, 160))), (x[:1500], rng.permutation(x)[:1500]), (np.arange(500), np.arange(500)[::-1])]
    want = whole(pairs)
    for values in (pairs, [(a * 10**7, b * 10**7) for a, b in pairs]):
        assert tuple(v.tolist() for v in bands.counts(values)) == want


@pytest.mark.parametrize("how", ["matches", "common"])
def test_long_lines_need_little_memory(how):
    """Whole tables of bits would take 136 MB each."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 33_000)
    y = np.delete(x, rng.integers(0, 33_000, 900))
    y[rng.integers(0, len(y), 5000)] = rng.integers(0, 30, 5000)
    counts = []
    tracemalloc.start()
    if how == "matches":
        counts.append(bands._long_matches(x, y, 9024))
    else:
        counts.append(bands._long_common(x, y, 12032))
    assert tracemalloc.get_traced_memory()[1] < 90e6
    tracemalloc.stop()
    assert counts[0][0] == bands.counts([(x, y)])[how == "common"][0]


def test_counts_of_texts(spark):
    rows = [("Iten per manum notarii", "It per manus notari."), ("x", ""), (None, "y"), ("x", None), ("é👍x", "👍"), ("", ""), ("ab" * 900, "ba" * 800)]
    df = spark.createDataFrame(rows, "x string, y string").coalesce(1)
    got = df.select(bands.alignment_counts("x", "y").alias("n"), F.size(distance.align("x", "y")).alias("a"), F.size(distance.align_lcs("x", "y")).alias("b"), "x", "y").collect()
    for r in got:
        assert r.n is None if r.x is None or r.y is None else tuple(r.n) == (r.a, r.b)


def test_counts_of_lines_take_a_part_of_the_time_of_their_paths():
    """Lines as they occur, of which a few are long."""
    rng = np.random.default_rng(9)
    pairs = []
    for size in [*rng.integers(20, 900, 600).tolist(), 6000, 20_000]:
        y = rng.integers(0, 30, size)
        pairs.append((np.where(y < 4, 31, y)[y != 5], y))
    began = time.perf_counter()
    got = bands.counts(pairs)
    took = time.perf_counter() - began
    began = time.perf_counter()
    want = whole(pairs)
    assert (got[0].tolist(), got[1].tolist()) == want
    assert took < 0.5 * (time.perf_counter() - began)


def test_texts_that_stay_as_they_are(spark):
    """Texts of characters that are not moved, of known ones up to U+00FF, of others on either side of it."""
    from vellum.plans.queries import ALPHABET

    of = {s: ALPHABET.representatives[c] for s, c in ALPHABET.codes.items() if len(s) == 1}
    texts = ["", "plain text, 1-2.", "(Éa) [b] \\ ^ |", "é!%é", "ꝑ and ž", "日本 a!", "a\n", "\n", "x👍", "ÿþ", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ALPHABET.reduce(F.col("t")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: t if t is None else "".join((of[c] if len(of[c]) == 1 else c) if c in of else "?" for c in t) for k, t in enumerate(texts)}
