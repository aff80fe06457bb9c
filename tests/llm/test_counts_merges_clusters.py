"""Operators 11 to 13 against plain definitions, with nulls, empties, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import branch_merge, centroids, token_counts
from vellum.llm.encoders import encoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- 12


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(4)
    words = ["the", "über", "it's", "WE'LL", "x'", "12", "3.14", "...", "漢字かな", "👍🏽", "<|endoftext|>", "<|endof", "text|>", "\n", "\n\n ", "   ", "\t", " ", "naïve", "́e"]
    mixed = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(5, 700))) for _ in range(25)]
    return [*mixed, "", None, " ", "a", "a" * 5000, " " * 4000, "ab" * 3000 + " end", "é" * 2500, "'s" * 1500, "<|endoftext|>" * 400, "x" * 1500 + "<|endoftext|>" * 30 + "y" * 1500, " \n" * 1500, "1" * 2000 + "<" * 1000]


def test_token_counts(spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3 + [(None, texts[4]), (None, None), (-(1 << 63), texts[5])]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", True) for i, t in rows], "doc_id long, text string, k int, ha int, n_tokens string, ends boolean").repartition(3)
    n = library([t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), c, c > 512) for (i, t), c in zip(rows, n, strict=True)]
    for chunk, overlap in ((32 << 10, 1 << 10), (256, 96), (1000, 60)):
        same([tuple(r) for r in token_counts.count_tokens(docs, PATH, chunk=chunk, overlap=overlap).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()], want)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_chunks_splice_where_words_begin(spark):
    """Prose splices at the first try; an unbroken run needs wider chunks, and its count is right, too."""
    rng = random.Random(9)
    prose = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    rows = spark.createDataFrame([(1, prose), (2, "q" * 6000)], "doc_id long, text string")
    rows = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "ha": F.xxhash64("text"), "hb": F.xxhash64("doc_id")})
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts._spliced(rows, PATH, 1024, 128).collect()}
    assert found == {1: library([prose])[0], 2: None}
    same([r["n_tokens"] for r in token_counts.count_tokens(rows, PATH, chunk=1024, overlap=128).collect()], library([prose, "q" * 6000]))


def test_whole_characters():
    text = "aé漢👍z".encode()
    for lo in range(len(text) + 1):
        for hi in range(lo, len(text) + 1):
            a, b = token_counts._whole_characters(text[lo:hi])
            text[lo:hi][a:b].decode()
            assert a < 4 and hi - lo - b < 4


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"))


def test_units_are_those_of_the_library():
    enc = encoder(PATH)
    texts = [t for t in odd_texts() if t is not None]
    starts, before, offsets = token_counts.units(enc, pa.array(texts))
    assert np.diff(before[np.searchsorted(starts, offsets)]).tolist() == library(texts)


# --- 11


def plain_clusters(rows, k=40, rounds=5, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    packed = lambda q: np.array(q, "<i4").tobytes()
    c = [list(q) for _, q in sorted(kept, key=lambda r: (name(r[0]), packed(r[1])))[:k]]
    far = lambda q, p: sum((a - b) ** 2 for a, b in zip(q, p, strict=True))
    for turn in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (far(q, c[j]), j)) for _, q in kept]
        if turn < rounds:
            for j in range(len(c)):
                mine = [q for (_, q), a in zip(kept, own, strict=True) if a == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    d = [far(q, c[a]) for (_, q), a in zip(kept, own, strict=True)]
    each = [sum(x for x, a in zip(d, own, strict=True) if a == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, a, x, each[a], sum(d), sha[a]) for (i, _), a, x in zip(kept, own, d, strict=True)]


def embedded(n, seed, size=64, scale=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, scale, (7, size))
    return [(i, (middle[rng.integers(7)] + rng.normal(0, scale / 3, size)).tolist()) for i in range(n)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def clusters(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    return [tuple(r) for r in centroids.clustered(df, **options).select(*COLUMNS).collect()]


def test_centroids(spark):
    rows = embedded(260, 1)
    hot = rows[0][1]
    odd = [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, [None, *[0.1] * 63]), (904, [float("nan"), *[0.1] * 63]), (905, [*[0.1] * 63, float("inf")]), (906, [])]
    ties = [(7, hot), (None, hot), (None, rows[3][1]), (-5, [0.0] * 64), (-6, [-0.001] * 64), (907, [1000.0] * 64), (908, [-30000.5] * 64)]
    rows += odd + ties + [(i, hot) for i in range(2000, 2100)]
    same(clusters(spark, rows), plain_clusters(rows))


def test_few_vectors_and_none(spark):
    rows = embedded(5, 2)
    same(clusters(spark, rows), plain_clusters(rows))
    same(clusters(spark, rows[:1]), plain_clusters(rows[:1]))
    assert clusters(spark, []) == clusters(spark, [(1, None)]) == []
    same(clusters(spark, rows, k=3, rounds=0), plain_clusters(rows, 3, 0))
    with pytest.raises(Exception, match="would not fit"):
        clusters(spark, [(1, [1e9] * 64)])


def test_bounds_spare_scans_and_change_nothing():
    """Rounds with bounds against scans of everything, with components so large that doubles are not exact, and fewer scans than vectors."""
    for scale in (200, 1 << 24):
        rng = np.random.default_rng(scale)
        x = np.concatenate([rng.integers(-scale, scale, (1, 64)) + rng.integers(-scale // 9, scale // 9 + 1, (300, 64)) for _ in range(6)])
        c, state, drift, scanned = x[rng.permutation(len(x))[:12]], None, None, []
        for _ in range(6):
            *state, n = centroids.assign(x, c, state, drift)
            scanned.append(n)
            exact = np.array([[int(((p - q).astype(object) ** 2).sum()) for q in c] for p in x[::7]])
            assert (state[0][::7] == exact.argmin(axis=1)).all()
            moved = np.stack([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(len(c))])
            drift = centroids.above(np.array([centroids._to(moved[j : j + 1], c[j])[0] for j in range(len(c))]))
            c = moved
        assert scanned[0] == len(x) and min(scanned[2:]) < len(x) / 2


# --- 13


def plain_merge(rows):
    out = []
    for i, text, lang, source in rows:
        code = lambda b, name, i=i: zlib.crc32(f"{b}:{'' if i is None else i}:{name}".encode()) % 7
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        side = {}
        for b in "LR":
            cols = {c: ["", v + "!", v + "?", v, v, v, v][code(b, c)] for c, v in base.items()}
            codes = [code(b, k) for k in range(len(lines))]
            at = [None if c == 0 else x + {1: "!", 2: "?"}.get(c, "") for x, c in zip(lines, codes, strict=True)]
            gaps = [{3: "!", 4: "?"}.get(c) for c in codes]
            row = code(b, "row")
            side[b] = (row == 0, cols, at, gaps, {3: "!", 4: "?"}.get(row))
        (dl, cl, ll, gl, al), (dr, cr, lr, gr, ar) = side["L"], side["R"]
        changed = {b: s[1] != base or s[2] != lines or any(s[3]) for b, s in side.items()}
        joined = lambda at, gaps: "\n".join(x for pair in zip(at, gaps, strict=True) for x in pair if x is not None)
        n = dict.fromkeys(("clean", "ee", "ed", "ii"), 0)

        def unit(b, x, y, n=n):
            if x != b or y != b:
                n["clean" if x == b or y == b or x == y else "ii" if b is None else "ed" if None in (x, y) else "ee"] += 1
            return y if y != b else x

        if dl or dr:
            fight = (dl and not dr and changed["R"]) or (dr and not dl and changed["L"])
            n["ed" if fight else "clean"] += 1
            now = (cr, joined(lr, gr)) if fight and not dr else None
        else:
            now = {c: unit(base[c], cl[c], cr[c]) for c in base}, joined([unit(*u) for u in zip(lines, ll, lr, strict=True)], [unit(None, *u) for u in zip(gl, gr, strict=True)])
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((i, *(now[0].values() if now else (None, None)), sha(now[1]) if now else None, *n.values()))
        if al or ar:
            out.append((None if i is None else -1 - i, *base.values(), sha(ar or al), int(not (al and ar and al != ar)), 0, 0, int(bool(al and ar and al != ar))))
    return out


def test_branch_merge(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice(["", "a", "be", "ü!", "x?"]) for _ in range(rng.randint(0, 12))), rng.choice([None, "", "en", "de"]), rng.choice([None, "s1", ""])) for i in range(400)]
    rows += [(400, None, None, None), (401, "", "en", "s"), (402, "\n", "en", "s"), (403, "x\n" * 3000, "en", "s"), (None, "a\nb", "en", "s"), (5, "twice", "en", "s"), (5, "twice", "en", "s"), ((1 << 63) - 1, "e", "x", "y"), (-(1 << 63), "e", "x", "y"), (-9, "neg", "x", "y")]
    docs = spark.createDataFrame([(*r, 1, "x", "y", 3) for r in rows], "doc_id long, text string, lang string, source string, n_clean int, lines string, left string, _units int").repartition(3)
    want = plain_merge(rows)
    got = branch_merge.digests(docs)
    same([tuple(r) for r in got.select("doc_id", "lang", "source", "text_sha256", *branch_merge.COUNTS).collect()], want)
    assert {k for r in want for k in range(4) if r[4 + k]} == {0, 1, 2, 3}
    assert branch_merge.digests(docs.limit(0)).collect() == []
    plan = branch_merge.digests(spark.createDataFrame(rows[:5], "doc_id long, text string, lang string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Python", "Arrow", "Join"))


def test_merge_of_given_branches(spark):
    side = lambda b: f"{b}_dropped boolean, {b}_columns struct<title:string>, {b}_lines array<struct<text:string,after:string>>, {b}_added string"
    keep = lambda *lines, title="t", dropped=False, added=None: (dropped, (title,), list(lines), added)
    rows = [
        (1, "t", ["a", "b"], *keep(("a", None), ("B", "new")), *keep(("A", None), ("b", "other"), title="T")),
        (2, "t", ["a"], *keep(("a", None), dropped=True), *keep(("a", None))),
        (3, "t", ["a"], *keep(("a", None), dropped=True), *keep(("a", "z"))),
        (4, "t", ["a"], *keep((None, None), added="new\nrow"), *keep(("b", None))),
        (5, "t", [], *keep(), *keep()),
    ]
    df = spark.createDataFrame(rows, f"id long, title string, lines array<string>, {side('left')}, {side('right')}")
    got = {r["id"]: (r["title"], r["lines"], *(r[c] for c in branch_merge.COUNTS)) for r in branch_merge.merge(df, "id", ["title"]).collect()}
    assert got == {1: ("T", ["A", "B", "other"], 3, 0, 0, 1), 2: (None, None, 1, 0, 0, 0), 3: ("t", ["a", "z"], 0, 0, 1, 0), 4: ("t", ["b"], 0, 0, 1, 0), 5: ("t", [], 0, 0, 0, 0), -5: ("t", ["new", "row"], 1, 0, 0, 0)}
