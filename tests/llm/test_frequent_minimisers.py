"""Super-k-mers of minimisers that are in very many windows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import substring_dedup
from vellum.llm.routing import parts_of
from vellum.llm.substring_dedup import MINIMISER, PARTS, _Chunk

WIDTH = 13
SPAN = WIDTH - MINIMISER + 1


def chunk_of(texts, frequent=None):
    return _Chunk(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), WIDTH, frequent)


def windows_of(c):
    """(words, key, minimiser) of every window of a chunk's pieces, in the order of the text."""
    out = []
    for k in range(len(c.first)):
        for w in range(int(c.first[k]), int(c.first[k] + c.windows[k])):
            out.append((w, bytes(c.raw[c.start[w] : c.start[w + WIDTH]]), int(c.key[k]), int(c.minimiser[k])))
    return [x[1:] for x in sorted(out)]


def test_number_of_parts():
    got = parts_of(np.array([2, 10, 11, 40, 41, 160, 161, 1 << 40]), SPAN, 10, PARTS).tolist()
    assert got == [1, 1, 2, 2, 4, 4, SPAN, SPAN]
    assert parts_of(np.array([1 << 40]), 1, 10, PARTS).tolist() == [1]  # nothing to tell windows apart by


@pytest.mark.parametrize("parts", [2, 3, 4, SPAN])
def test_equal_windows_keep_one_key(parts):
    rng = random.Random(parts)
    words = [f"w{i}" for i in range(12)]  # few, so that trigrams and windows are repeated
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [t + " " + rng.choice(words) for t in texts[:30]] + ["", "one two", " ".join(["same"] * 40)]
    plain = chunk_of(texts)
    known = np.unique(plain.minimiser)
    cut = chunk_of(texts, (known, np.full(len(known), parts, np.uint8)))
    before, after = windows_of(plain), windows_of(cut)
    assert [(w, m) for w, _, m in before] == [(w, m) for w, _, m in after]  # each window once, under its minimiser
    key = {}
    for w, k, _ in after:
        assert key.setdefault(w, k) == k
    assert len(set(key.values())) > len(known)
    # minimisers that are not frequent are left alone
    some = chunk_of(texts, (known[::2], np.full(len(known[::2]), parts, np.uint8)))
    left = ~np.isin(some.minimiser, known[::2])
    assert (some.key[left] == some.minimiser[left]).all() and (some.key[~left] != some.minimiser[~left]).all()


def test_a_common_phrase_is_dealt_by_its_surroundings():
    rng = random.Random(3)
    texts = [" ".join([f"a{rng.randrange(10**9)}" for _ in range(12)] + ["in", "the", "end"] + [f"b{rng.randrange(10**9)}" for _ in range(12)]) for _ in range(800)]
    plain = chunk_of(texts)
    common, most = Counter(plain.minimiser.tolist()).most_common(1)[0]
    assert most > 10
    cut = chunk_of(texts, (np.array([common], np.uint64), np.array([SPAN], np.uint8)))
    assert max(Counter(cut.key[cut.minimiser == common].tolist()).values()) == 1
    two = chunk_of(texts, (np.array([common], np.uint64), np.array([2], np.uint8)))
    assert max(Counter(two.key[two.minimiser == common].tolist()).values()) == 1
    assert sum(two.windows) == sum(cut.windows) == sum(plain.windows)


def test_a_passage_in_other_surroundings(spark):
    """A passage of 25 words in many texts goes from all but the first, and nothing else, however its minimisers are cut."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(25)]
    rows = [(d, " ".join([f"x{rng.randrange(10**12)}" for _ in range(14)] + passage + [f"y{rng.randrange(10**12)}" for _ in range(14)])) for d in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1 << 14, 500, 100, 30):
        got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, chunk_bytes=20000, bucket_bytes=20000, hot=hot).collect()}
        assert got == {d: 25 if d else 0 for d in range(1500)}
