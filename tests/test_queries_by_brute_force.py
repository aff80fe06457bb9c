"""Queries that SQL cannot express, over a small table, against plain definitions."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pytest

from vellum.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    turns = [(c, t, rng.choice(["user", "system"]), "".join(rng.choice("rnumabe é-") for _ in range(rng.choice([0, 1, 7, 25, 60])))) for c in range(6) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    docs = [(i, rng.choice(["en", "de"]), "s", "\n".join("".join(rng.choice("rnumabe é-?") for _ in range(rng.choice([0, 1, 9, 40, 90, 700]))) for _ in range(4))) for i in range(7)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{path}/documents.parquet")
    frames = [(i, i % 3, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(15)]
    spark.createDataFrame(frames, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    read = [(c, t, r, reduced(x), reduced(x).translate(str.maketrans({"r": "m", "n": "m", "u": None}))) for c, t, r, x in turns]
    return path, read, frames


def reduced(text: str) -> str:
    of = queries.ALPHABET.representatives
    return "".join(of[queries.ALPHABET.codes[c]] if c in queries.ALPHABET.codes else "?" for c in text)


def distances(x, y, free=()):
    """Table of edit distances; edits at the places `free` of y cost nothing."""
    cost = lambda j: 0 if j in free else 1
    rows = [[sum(cost(k) for k in range(j)) for j in range(len(y) + 1)]]
    for a in x:
        row = [None] * (len(y) + 1)
        for j in range(len(y) + 1):
            row[j] = rows[-1][0] + 1 if j == 0 else rows[-1][j - 1] if a == y[j - 1] else min(rows[-1][j - 1], rows[-1][j], row[j - 1]) + cost(j - 1)
        rows.append(row)
    return rows


def back_trace(x, y):
    """Pairs (x's element or None, y's or None): diagonal where equal or least, else up, else left."""
    rows, i, j, out = distances(x, y), len(x), len(y), []
    while i or j:
        d, u, l = (rows[i - 1][j - 1] if i and j else math.inf), (rows[i - 1][j] if i else math.inf), (rows[i][j - 1] if j else math.inf)
        if i and j and (x[i - 1] == y[j - 1] or d <= min(u, l)):
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif u <= l:
            i -= 1
            out.append((x[i], None))
        else:
            j -= 1
            out.append((None, y[j]))
    return out


def common(x, y) -> int:
    """Length of a longest common subsequence."""
    row = [0] * (len(y) + 1)
    for a in x:
        last, row = row, [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1]


def test_stand_in_reads_as_the_fixture_says(spark, tables):
    path, read, _ = tables
    got = queries._read(spark.read.parquet(f"{path}/conversations.parquet")).select("conv_id", "turn", "role", "gt", "pred").collect()
    assert sorted(map(tuple, got)) == sorted(read)


def test_masked_rates(spark, tables):
    path, read, _ = tables
    free = {*range(5, 15), *range(30, 34)}
    by = collections.defaultdict(list)
    turns = []
    for c, t, role, gt, pred in read:
        masked = distances(pred, gt, free)[-1][-1]
        turns.append((c, t, masked))
        by[role].append((len(gt), distances(pred, gt)[-1][-1], masked))
    assert sorted(map(tuple, queries.QUERIES["masked_turns"](spark, path).collect())) == sorted(turns)
    got = {r.role: r for r in queries.QUERIES["mer_conversations"](spark, path).collect()}
    for role, v in by.items():
        full = [x for x in v if x[0]]
        assert got[role].n == len(v)
        assert got[role].cer == pytest.approx(np.mean([e / n for n, e, _ in full]), abs=2e-6) and got[role].mer == pytest.approx(np.mean([m / n for n, _, m in full]), abs=2e-6)
        assert got[role].mask_share == pytest.approx(1 - sum(m for _, _, m in v) / sum(e for _, e, _ in v), abs=2e-6)


def test_alignments(spark, tables):
    path, read, _ = tables
    want = [(c, t, sum(a == b for a, b in back_trace(pred, gt)), common(pred, gt)) for c, t, _, gt, pred in read]
    assert sorted(map(tuple, queries.QUERIES["alignment_pairs"](spark, path).collect())) == sorted(want)


def test_confusions(spark, tables):
    path, read, _ = tables
    batches = collections.defaultdict(collections.Counter)
    for c, _, _, gt, pred in read:
        batches[c].update(back_trace(gt, pred))
    total = sum(batches.values(), collections.Counter())
    row = lambda counts: collections.Counter({g: sum(n for (a, _), n in counts.items() if a == g) for g, _ in counts})
    named = lambda r: (r.gt_char, r.pred_char)
    got = {named(r): (r.n, r.share) for r in queries.QUERIES["confusion_counts"](spark, path).collect()}
    assert got == {k: (n, pytest.approx(n / row(total)[k[0]], abs=2e-6)) for k, n in total.items()}
    mean = collections.Counter()
    for counts in batches.values():
        for k, n in counts.items():
            mean[k] += n / row(counts)[k[0]] / len(batches)
    assert {named(r): r.share for r in queries.QUERIES["confusion_batches"](spark, path).collect()} == {k: pytest.approx(v, abs=2e-6) for k, v in mean.items()}


def test_alignments_and_confusions_of_documents(spark, tables):
    path, *_ = tables
    lines, by = [], collections.defaultdict(collections.Counter)
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        for k, line in enumerate(r.text.split("\n")):
            gt = reduced(line)
            pred = gt.translate(str.maketrans({"r": "m", "n": "m", "u": None}))
            lines.append((r.doc_id, k, sum(a == b for a, b in back_trace(pred, gt)), common(pred, gt)))
            by[r.lang].update(back_trace(gt, pred))
    assert sorted(map(tuple, queries.QUERIES["alignment_lines"](spark, path).collect())) == sorted(lines)
    want = {(lang, a, b): (n, pytest.approx(n / sum(m for (x, _), m in counts.items() if x == a), abs=2e-6)) for lang, counts in by.items() for (a, b), n in counts.items()}
    assert {(r.lang, r.gt_char, r.pred_char): (r.n, r.share) for r in queries.QUERIES["confusion_documents"](spark, path).collect()} == want


def test_beams_by_enumeration(spark, tables):
    path, _, frames = tables
    by = collections.defaultdict(list)
    for _, label, scores in sorted(frames):
        e = np.exp(np.array(scores, np.float32).astype(float))
        by[label].append(e / e.sum())
    got = {r.sequence: r for r in queries.QUERIES["beam_decode"](spark, path).collect()}
    for label, probabilities in by.items():
        total = collections.Counter()
        for way in itertools.product(range(4), repeat=len(probabilities)):
            kept = tuple(s for k, s in enumerate(way) if s and (k == 0 or way[k - 1] != s))
            total[kept] += math.prod(p[s] for p, s in zip(probabilities, way, strict=True))
        labels = tuple(map(int, got[label].labels.split()))
        # three beams find one of the likeliest texts, and no more than its probability
        assert math.log(total[labels]) >= got[label].log_p - 1e-3
        assert total[labels] >= sorted(total.values())[-5]
        from vellum.operators.decoding import beam

        best, log_p = beam(np.array(probabilities), 10_000)
        assert tuple(best) == max(total, key=total.get) and log_p == pytest.approx(math.log(max(total.values())))


def test_normal_form_with_compatibility_characters(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    texts = ["ﬁne ﬂow", "①②", "Ａｂ", "x²", "  Å  é", "ßæ ŒÆœ", "…", " a b", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        t = re.sub(r"\s+", " ", t).strip()
        for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
            t = t.replace(a, b)
        want.append((i, hashlib.md5(unicodedata.normalize("NFKC", t).encode()).hexdigest()))
    assert sorted(map(tuple, queries.QUERIES["normalize_text"](spark, str(tmp_path)).collect())) == want
