"""The ten operators against brute force, on a small table with every odd case: nulls, empty and long texts, ties, repeated rows,
columns whose names clash with the operators' own."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import fingerprints, flat, jaccard_join, line_quality, merges, packing, sentencepiece, sharding, shared, substring_dedup, suffix_dedup, token_files, warc
from vellum.llm.encoders import encoder, tokenizer_path
from vellum.llm.routing import Routing
from vellum.llm.shared import fresh

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, size int, key string, node string, range int, guest boolean, rest string, bucket int, label string, text_hash long, rid long, _hash string, part int, shard int, id long, host string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "sting", "añade", "über", "onion", "œuvre", "x1", "Ab's", "7", "...", "漢字", "👍"]) + rng.choice(["", "er", "ing", "-", ","]) for _ in range(n))


def rows():
    rng = random.Random(7)
    shared = prose(rng, 60)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(20)]
    near = base[0].split(" ")
    near[10] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), f"{base[2]}\n{shared}", f"{shared}\n{base[3]}", "", None, "one", "  \n\t ", "a" * 1500, "ab " * 400, prose(rng, 9000), "line\nline\nline\n" + base[4]]
    out = [(i, t) for i, t in enumerate(texts)] + [(5, base[5]), (5, base[6]), (None, base[7]), (None, None), (-3, base[8])]
    rng.shuffle(out)
    return [(i, t, "en", None if k % 11 == 0 else f"src{k % 2}", None if t is None else len(t), *[None] * 16) for k, (i, t) in enumerate(out)]


ROWS = rows()


def far_apart():
    """Ids at both ends of their type, one that many texts share, and none."""
    rng = random.Random(12)
    ids = [-(1 << 63), 7, (1 << 63) - 1, *[5] * 30, None, None, 7]
    made = [(i, prose(rng, rng.randint(10, 150))) for i in ids]
    return [(i, t, "en", "h", len(t), *[None] * 16) for i, t in made]


@pytest.fixture(autouse=True)
def frequent_and_other_keys(monkeypatch):
    """Small tables have keys of both kinds."""
    monkeypatch.setattr(shared, "SHARE", 12)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text(row) -> str:
    return row[1] or ""


def tie(row) -> int:
    """Spark's hash of a text, which orders rows of one id."""
    h = xxhash.xxh64_intdigest(text(row).encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    assert packing.pack(empty, path).count() == 0
    library = Tokenizer.from_file(path)
    left = collections.defaultdict(list)
    for r in ROWS:
        left[r[0]].append(np.array([*library.encode(text(r), add_special_tokens=False).ids, 2], "<u4"))
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for p in packing.pack(docs, path).collect():
        places[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) for v in left.values() for x in v)
    assert sum(n for v in places.values() for _, n in v) == total
    assert len(places) <= -(-total // 4096) + 3  # at most one sequence a partition is not full
    for name, ids in left.items():
        want = collections.Counter()
        for x in ids:
            want[len(x)] += len(x)
        assert want == collections.Counter({n: sum(p[1] for p in v) for (d, n), v in pieces.items() if d == name})
    whole = {x.tobytes() for v in left.values() for x in v}
    for (_, n), v in pieces.items():
        for start, length, crc in v:
            assert any(zlib.crc32(w[4 * start : 4 * (start + length)]) == crc for w in whole if len(w) == 4 * n)


def plain_assign(lengths, capacity, linear=1.0, quadratic=1.0 / 4096):
    """The rule in words: full sequences first; then pieces in descending order to the cheapest sequence with room, cut at the largest room where none has."""
    out, full, items = [], 0, []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((doc, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            items.append((n % capacity, doc, n - n % capacity))
    open_ = [[capacity, 0.0] for _ in range(-(-sum(x[0] for x in items) // capacity))]
    while items:
        items.sort(key=lambda x: (-x[0], x[1], x[2]))
        size, doc, start = items.pop(0)
        fits = [s for s, (room, _) in enumerate(open_) if room >= size]
        s = min(fits, key=lambda s: (open_[s][1], s)) if fits else max(range(len(open_)), key=lambda s: (open_[s][0], -s))
        take = min(size, open_[s][0])
        if take < size:
            items.append((size - take, doc, start + take))
        out.append((doc, start, take, full + s, capacity - open_[s][0]))
        open_[s][0] -= take
        open_[s][1] += linear * take + quadratic * take * take
    return out


def test_packing_assigns_to_lowest_cost():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([8, 64, 4096])
        lengths = [rng.randint(1, rng.choice([capacity // 4 + 1, capacity, 3 * capacity])) for _ in range(rng.randint(0, 40))]
        assert sorted(packing.assign(np.array(lengths, np.int64), capacity)) == sorted(plain_assign(lengths, capacity))
    assert packing.assign(np.array([5]), 4096) == [(0, 0, 5, 0, 0)]


def test_packing_a_text_longer_than_a_group(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, "a b c"), (3, "other " * 2500)], "doc_id long, text string")
    want = {r.doc_id: r.doc_tokens for r in packing.pack(df, tokenizer_path("word_bpe_49k.json")).collect()}
    got = packing.pack(df.coalesce(1), tokenizer_path("word_bpe_49k.json"), group_tokens=1000).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.start, r.length))
    for d, v in by.items():
        assert sum(n for _, n in v) == want[d] and [a for a, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1]]


def test_substring_dedup(docs, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    words = [(r[0], WORD.findall(text(r))) for r in ROWS]
    first = {}
    for d, w in words:
        if d is not None:
            for k in range(len(w) - 12):
                t = tuple(w[k : k + 13])
                first[t] = min(first.get(t, d), d)
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    same([tuple(r) for r in substring_dedup.remove_repeats(docs).collect()], want)
    for hot in (0, 1):  # all minimisers are frequent, to one degree or another
        same([tuple(r) for r in substring_dedup.remove_repeats(docs, hot=hot).collect()], want)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "Rolling", lambda v: type("Same", (), {"of": staticmethod(lambda a, b: np.zeros(len(a), np.uint64))}))
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    order, lead = substring_dedup.same_windows(ids, np.array([0, 3, 6]), 3)
    assert lead.sum() == 2 and set(order[:2]) == {0, 2}


def brute_bytes(length: int):
    raw = [(r[0], text(r).encode()) for r in ROWS]
    count = collections.Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        yield d, b, gone


def test_suffix_dedup(docs, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    want = [(d, len(b), int(g.sum()), int((g & ~np.append(False, g)[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for d, b, g in brute_bytes(200)]
    same([tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()], want)
    same([tuple(r) for r in suffix_dedup.remove_repeats(docs, large=0).collect()], want)  # every group counts as large
    for hot in (0, 1):  # all minimisers are frequent, to one degree or another
        same([tuple(r) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()], want)


def test_suffix_dedup_of_a_passage_in_many_surroundings(spark):
    """1,500 documents share 150 bytes, and 1,500 others 240, in surroundings of their own."""
    rng = np.random.default_rng(5)
    made = lambda n, k: ["".join(map(chr, x)) for x in rng.integers(97, 123, (k, n))]
    (short,), (long,) = made(150, 1), made(240, 1)
    texts = [a + m + b for m in (short, long) for a, b in zip(made(170, 1500), made(170, 1500), strict=True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want[i] = int(gone.sum())
    assert sum(want.values()) >= 1500 * 240
    for hot in (1 << 14, 700, 60):  # whole, in two parts, in 32 parts
        assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, large=1 << 16, hot=hot).collect()} == want


def test_suffix_dedup_settles_equal_pieces_by_the_transform(spark, monkeypatch):
    rng = random.Random(11)
    one, two = prose(rng, 150), prose(rng, 150)
    df = spark.createDataFrame([(1, one), (2, one), (3, two), (4, prose(rng, 150))], "doc_id long, text string")
    sent = [r.n_removed for r in suffix_dedup.remove_repeats(df, chunk_bytes=1000).orderBy("doc_id").collect()]
    assert sent == [len(one.encode())] * 2 + [0, 0]
    monkeypatch.setattr(suffix_dedup, "repeated", lambda raw, size, length, times: np.zeros(len(raw), bool))
    by_hash = suffix_dedup.remove_repeats(df, chunk_bytes=1000)
    assert [r.n_removed for r in by_hash.collect()] == [0] * 4  # nothing is removed that the expansion has not found


def test_equal_content_hashes_of_different_pieces_are_noticed():
    raw = np.frombuffer(b"aaab", np.uint8)
    at, size = np.array([0, 2, 1]), np.array([2, 2, 2])
    substring_dedup.alike(raw, at, size, np.array([0]), np.array([2]))
    with pytest.raises(ValueError):
        substring_dedup.alike(raw, at, size, np.array([0]), np.array([1]))


def test_suffix_dedup_keeps_columns(docs):
    out = suffix_dedup.clean(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = [(d, np.frombuffer(b, np.uint8)[~g].tobytes().decode(errors="ignore")) for d, b, g in brute_bytes(200)]
    same([(r.doc_id, r.text) for r in out.collect()], want)


def test_interval_expansion_on_random_strings():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        size = np.array([len(t) for t in texts])
        times = np.array([rng.choice([1, 1, 3]) for _ in texts])
        for length in (1, 2, 5, 9):
            got = suffix_dedup.repeated(np.frombuffer("".join(texts).encode(), np.uint8), size, length, times)
            count = collections.Counter(t[k : k + length] for t, m in zip(texts, times, strict=True) for k in range(len(t) - length + 1) for _ in range(m))
            want = [k + length <= len(t) and count[t[k : k + length]] > 1 for t in texts for k in range(len(t))]
            assert got.tolist() == want, (texts, length)


@pytest.mark.parametrize("together", [1, 7, 1 << 21])
def test_thinned_pieces_give_what_whole_ones_give(monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "SORTED", together)
    rng = np.random.default_rng(together)
    for _ in range(80):
        length, letters, base = int(rng.choice([3, 5, 8])), int(rng.choice([2, 3, 6])), rng.integers(0, 3, 40)
        pieces = collections.Counter()
        for _ in range(rng.integers(1, 30)):
            m, at = int(rng.integers(length, 30)), int(rng.integers(0, 8))
            pieces[(rng.integers(0, letters, m) if rng.random() < 0.5 else base[at : at + m]).astype(np.uint8).tobytes()] += int(rng.integers(1, 3))
        raw, size, times = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), np.array(list(pieces.values()))
        assert (suffix_dedup.thinned(raw, size, length, times) == suffix_dedup.repeated(raw, size, length, times)).all()


def test_thinned_pieces_take_little_memory():
    """60,000 pieces of one minimiser that share 150 bytes: no window of 200 is repeated."""
    import tracemalloc

    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, (60_000, 350)).astype(np.uint8)
    raw[:, 100:250] = raw[0, 100:250]
    tracemalloc.start()
    assert not suffix_dedup.thinned(raw.reshape(-1), np.full(60_000, 350), 200, np.ones(60_000)).any()
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_sentencepiece(docs, empty):
    import sentencepiece as library

    path = tokenizer_path("piece_bpe_32k.model")
    assert sentencepiece.digests(empty, path).count() == 0
    model = library.SentencePieceProcessor(model_file=path)
    want = []
    for r in ROWS:
        ids = model.encode(text(r), add_bos=True, add_eos=True)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    same([tuple(r) for r in sentencepiece.digests(docs, path).collect()], want)
    for r in sentencepiece.encode(docs, path).collect():
        assert model.decode(r.ids) == r.decoded


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoders_equal_their_libraries(name):
    rng = random.Random(5)
    parts = ["a", "B", "É", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "'ll", "1", "23", "!", "--", "<|endoftext|>", "<|startoftext|>", " ", "漢", "é", "Σ", "İ", "▁", "œ", "×", "<|", "\x00", " ", "😀", " the", "ing", "\r\n", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "a" * 3000, "\n", " a", "a \n b"]
    ids, at = encoder(tokenizer_path(name)).encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    if name.endswith(".model"):
        import sentencepiece as library

        want = library.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(texts)
    else:
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_merges_of_long_units(monkeypatch):
    import sentencepiece as library

    path = tokenizer_path("piece_bpe_32k.model")
    model, rng = library.SentencePieceProcessor(model_file=path), random.Random(13)
    texts = [unit * n for unit in ("the", "ing", "abcabd", "a", "tion", "hehe") for n in (700, 20_000)] + ["the" * 350_000]
    texts += ["".join(rng.choice("abcdefghij"[: rng.randint(2, 10)]) if rng.random() < 0.8 else rng.choice(["the", "ing", "漢", "字", "é"]) for _ in range(2000)) for _ in range(20)]
    for most in (256, 4):  # 4: most words end in the queue
        monkeypatch.setattr(merges, "LONG", most)
        for t in texts if most > 4 else texts[13:]:
            ids, _ = encoder(path).encode(pa.array([t]))
            assert ids.tolist() == model.encode(t)
    m = encoder(path).merges
    for t in texts[13:]:
        sym = encoder(path).char[np.array([ord(c) for c in t])]
        assert merges.merge_queue(m, sym).tolist() == merges.merge_rounds(m, sym, np.array([len(sym)]))[0].tolist()


def test_token_files(spark, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert token_files.write_and_read(empty, path).count() == 0
    library = Tokenizer.from_file(path)
    for made in (ROWS, far_apart()):
        coded = [(r[0], tie(r), np.array([*library.encode(text(r), add_special_tokens=False).ids, 0], "<u4")) for r in made]
        coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        at, want = 0, []
        for d, _, ids in coded:
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        df = spark.createDataFrame(made, SCHEMA).repartition(3)
        same([tuple(r) for r in token_files.write_and_read(df, path).collect()], want)
        where = fresh(spark, "tokens")
        manifest = token_files.write(df, path, where, range_bytes=3000, file_tokens=200)
        same([tuple(r) for r in token_files.read(manifest).collect()], want)
        assert manifest.count() > manifest.select("range").distinct().count() > 3


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_directly_addressable_codes(bits):
    ids = np.random.default_rng(1).integers(0, 70000, 3000) >> np.random.default_rng(2).integers(0, 17, 3000)
    dac = token_files.Dac(token_files.dac_encode(ids, bits), bits)
    assert all(dac.get(i) == ids[i] for i in range(0, 3000, 7))
    assert (dac.slice(0, 3000) == ids).all() and (dac.slice(701, 1999) == ids[701:1999]).all() and len(dac.slice(5, 5)) == 0
    _, at, again = token_files.load(token_files.dump(pa.array([1, None]), np.array([0, 10, 3000]), ids, 8))
    assert (again.slice(0, 3000) == ids).all() and at.tolist() == [0, 10, 3000]


def test_warc(spark):
    rng = random.Random(2)
    pages = [(i, f"http://a/{i}", prose(rng, 300)) for i in range(12)]
    pages += [(20, "u", pages[3][2]), (21, "u", pages[3][2]), (22, "u", "short"), (23, "u", "short"), (24, None, None), (25, "u\r\nX: y", ""), (21, "u", pages[3][2]), (None, "u", pages[4][2]), (-5, "u", pages[5][2])]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, range int, digest string").repartition(3)
    top = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        to = top.get(h) if i is not None and i != top.get(h) else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    same([tuple(r) for r in warc.write_and_read(df).collect()], want)
    far = [(i, "u", t) for i, t, *_ in far_apart()] + [(-(1 << 63), "u", "x" * 2000), ((1 << 63) - 1, "v", "x" * 2000)]
    got = warc.write_and_read(spark.createDataFrame(far, "page_id long, url string, html string")).collect()
    same([(r.page_id, r.payload_bytes) for r in got], [(i, len(t.encode())) for i, _, t in far])
    assert [(r.page_id, r.refers_to) for r in got if r.refers_to is not None] == [(-(1 << 63), (1 << 63) - 1)]
    one, two = fresh(spark, "warc"), fresh(spark, "warc")
    made = [sorted(tuple(r) for r in warc.write(x, p, roll_bytes=1500, range_bytes=4000).collect()) for x, p in ((df, one), (df.repartition(5), two))]
    assert made[0] == made[1] and len(made[0]) > 3  # the same files, whatever the partitions
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_warc_rolls_by_compressed_size_at_its_own_parameters(spark):
    html = "array_join(transform(sequence(1, 1600), i -> translate(sha2(concat(id, '-', i), 256), '89abcdef', '01234567')), ' ')"
    df = spark.range(600).selectExpr("id AS page_id", "concat('http://a/', id) AS url", f"{html} AS html")
    made = sorted(tuple(r) for r in warc.write(df, fresh(spark, "warc")).select("range", "name", "records", "bytes").collect())
    assert sum(r[2] for r in made) == 600
    rolled = [a for a, b in zip(made, made[1:], strict=False) if a[0] == b[0]]  # files that do not end their range
    assert len(rolled) > len(made) / 2 and all(4 << 20 <= r[3] < (4 << 20) + 60000 for r in rolled)


def plain_fingerprint(raw: bytes) -> tuple[int, list[str]]:
    """(block size, letters at it, at twice and at four times it), byte by byte from the definition."""
    m = (1 << 64) - 1
    base, spread = flat.BASE, [int(x) for x in flat.SPREAD]

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def hashed(part):
        total = sum(spread[b] * pow(base, k, 1 << 64) for k, b in enumerate(part))
        return mix(total + len(part) * 0xD6E8FEB86659FD93 & m)

    rolled = [hashed(raw[max(0, k - 6) : k + 1]) for k in range(len(raw))]
    ends = lambda level: [k + 1 for k, h in enumerate(rolled) if h % (4 << level) == 0]
    level = 0
    while len(ends(level)) > 63:
        level += 1
    parts = []
    for k in range(level, level + 3):
        cut = [0, *ends(k), len(raw)]
        parts.append("".join(chr(fingerprints.LETTERS[hashed(raw[a:b]) >> 58]) for a, b in zip(cut, cut[1:], strict=False)))
    return 4 << level, parts


def plain_likeness(p, q) -> float:
    best = 0.0
    for i, x in enumerate(p[1]):
        for j, y in enumerate(q[1]):
            if p[0] << i == q[0] << j:
                row = list(range(len(y) + 1))
                for a, c in enumerate(x, 1):
                    last, row = row, [a]
                    for b, d in enumerate(y, 1):
                        row.append(min(last[b] + 1, row[-1] + 1, last[b - 1] + (c != d)))
                like = 1 - row[-1] / max(len(x), len(y))
                if like == 1 or {x[k : k + 3] for k in range(len(x) - 2)} & {y[k : k + 3] for k in range(len(y) - 2)}:
                    best = max(best, like)
    return best


def test_fingerprints(spark, empty):
    assert fingerprints.compare(empty).count() == 0
    for made in (ROWS, far_apart()):
        order = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r)))
        prints = [plain_fingerprint(text(r).encode()) for r in order]
        named = lambda p: ":".join([str(p[0]), *p[1]])
        want = []
        for k, a in enumerate(order):
            n = (k + 1) % len(order)
            s, t = text(a), text(order[n])
            half = len(s) // 2
            edited = (s[: len(s) - half] + t[:half]).encode()
            other = plain_fingerprint(edited)
            want.append((a[0], len(s), hashlib.sha256(edited).hexdigest(), named(prints[k]), named(other), round(plain_likeness(prints[k], other), 9), round(plain_likeness(prints[k], prints[n]), 9)))
        df = spark.createDataFrame(made, SCHEMA).repartition(3)
        for each in (2 << 20, 3000):
            got = fingerprints.compare(df, range_bytes=each).collect()
            same([(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got], want)


def test_fingerprint_likeness():
    rng = random.Random(4)
    a = prose(rng, 2000)
    b = prose(rng, 2000)
    p = fingerprints.Prints(*fingerprints.flat(pa.array([a, a, a[:6000] + b[:1000] + a[6000:], b, ""])))
    near = fingerprints.likeness(p, p, np.array([0, 0, 0, 4]), np.array([1, 2, 3, 4]))
    assert near[0] == near[3] == 1 and 0.5 < near[1] < 1 and near[2] < 0.2
    x, y = np.array([[1, 2, 3, 4] + [0] * 60, [5] * 64], np.uint8), np.array([[1, 3, 4, 4] + [0] * 60, [6] * 64], np.uint8)
    assert fingerprints.edit_distance(x, np.array([4, 64]), y, np.array([3, 64])).tolist() == [1, 64]


def test_sharding(docs, empty):
    assert sharding.shard(empty).count() == 0
    got = sharding.shard(docs, 4).collect()
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(r[0], len(text(r).encode()) + 1, zlib.crc32(text(r).encode())) for r in ROWS])
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = {k: sum(r["size"] for r in v) for k, v in by.items()}
    largest = max(len(text(r).encode()) for r in ROWS)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert max(sizes.values()) - sizes.get(0, 0) <= 2 * largest
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


@pytest.mark.parametrize("parts", [1, 1000])
def test_sharding_equals_a_plain_sort(spark, parts):
    made = ROWS + far_apart()
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    ordered = sorted(((tie(r), -(1 << 63) if r[0] is None else r[0]), len(text(r).encode()) + 1, zlib.crc32(text(r).encode()), r[0]) for r in [(x[0], x[1]) for x in made] for x in [r])
    total = sum(x[1] for x in ordered)
    got = sharding.shard(df, 4, part_bytes=parts).collect()
    for s in range(4):  # shards are consecutive in the sorted order, rows in its order; a border is the nearest place between different keys
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r["size"], r.text_crc32) for r in line] == [x[1:3] for x in ordered]
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(x[3] for x in ordered)
    places, at = {0, total}, 0
    for a, b in zip(ordered, ordered[1:], strict=False):
        at += a[1]
        if a[0] != b[0]:
            places.add(at)
    for s in range(1, 4):
        below = sum(r["size"] for r in got if r.shard < s)
        assert abs(below - total * s / 4) <= max(0.01 * total / 4, min(abs(p - total * s / 4) for p in places))


@pytest.mark.parametrize("share", [1, 5, 40, 4096])
def test_join_counted_equals_a_plain_join(spark, monkeypatch, share):
    monkeypatch.setattr(shared, "SHARE", share)
    keys = [None, *[7] * 100, *[8] * 10, 1, 2, 3, None, 99]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    right = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in (7, 8, 1, 2, 5)], "k long, n long, v string")
    got = shared.join_counted(left, shared.written(right, "keys"), ["k"], "n", len(keys))
    same([(r.k, r.i, r.n, r.v) for r in got.collect()], [(k, i, keys.count(k), f"v{k}") for i, k in enumerate(keys) if k in (7, 8, 1, 2, 5)])
    assert shared.join_counted(left.limit(0), shared.written(right.limit(0), "keys"), ["k"], "n", 0).count() == 0


def test_splitters_equal_brute_force(spark):
    rng = random.Random(8)
    keys = [rng.choice([5, 5, 5, rng.getrandbits(20), rng.getrandbits(128)]) for _ in range(500)]
    df = spark.createDataFrame([(k.to_bytes(16, "big"), 1 + k % 7) for k in keys], "key binary, size long")
    keys.sort()
    total = sum(1 + k % 7 for k in keys)
    targets = [total * i / 10 for i in range(1, 10)]
    for cut, target in zip(shared.splitters(df, targets, 0), targets, strict=True):
        below = lambda c: sum(1 + k % 7 for k in keys if k < c)
        assert abs(below(int.from_bytes(cut, "big")) - target) == min(abs(below(c) - target) for c in {*keys, keys[-1] + 1})
    cuts = sorted(set(shared.splitters(df, targets, 0)))
    got = df.select("key", shared.cell_of(cuts, shared.F.col("key")).alias("c")).collect()
    assert all(r.c == sum(c <= bytes(r.key) for c in cuts) for r in got)


def test_sharding_splits_a_hot_group(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sizes = [r["sum(size)"] for r in sharding.shard(df, 8).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8


def brute_quality(rows_, limit=6, keep_share=0.75):
    texts = collections.defaultdict(set)
    for r in rows_:
        texts[r[3]].add(text(r))
    norm = lambda t: {" ".join(WORD.findall(x)) for x in t.lower().split("\n")} - {""}
    above = {}
    for host, group in texts.items():
        count = collections.Counter(x for t in group for x in norm(t))
        above[host] = {x for x, n in count.items() if n > limit}
    for r in rows_:
        w = WORD.findall(text(r))
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        marked = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text(r).split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in text(r).split("\n") if " ".join(WORD.findall(x.lower())) in above[r[3]])
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        kept = "\n".join(x for x in text(r).split("\n") if " ".join(WORD.findall(x.lower())) not in above[r[3]])
        yield (r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text(r)), len(lines) - len(set(lines)), len(marked), gone, failed, not failed and len(w) - gone >= keep_share * len(w)), kept


def test_line_quality(docs, empty):
    assert line_quality.verdicts(line_quality.facts(empty)).count() == 0
    got = line_quality.verdicts(line_quality.facts(docs)).drop("rid", "places")
    same([tuple(r) for r in got.collect()], [v for v, _ in brute_quality(ROWS)])


def test_line_quality_removes_frequent_lines(spark):
    rng = random.Random(9)
    made = [(i, f"Menu  here #1\n{prose(rng, 70)}" if i % 2 else prose(rng, 60), "en", "h", 0) for i in range(80)]
    made += [(100 + i, "menu here #1\n" + "more of it " * 4 + f"\nmenu here #1\nMENU here #1 \n{prose(rng, 5)}", "en", "h", 0) for i in range(4)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    want = list(brute_quality(made))
    same([tuple(r) for r in line_quality.verdicts(line_quality.facts(df)).drop("rid", "places").collect()], [v for v, _ in want])
    out = line_quality.clean(df)
    assert out.columns == df.columns
    same([(r.doc_id, r.text) for r in out.collect()], [(v[0], t) for v, t in want if v[8]])


def test_line_quality_counts_texts_that_differ_only_in_form(spark):
    rng = random.Random(10)
    notice = [f"Notice {k} {prose(rng, 20)}" for k in range(3)]
    forms = [lambda x: x, str.upper, str.title, lambda x: x.replace(" ", "  "), lambda x: f" {x}\t"]
    made = []
    for i in range(30):
        lines = [forms[i % 5](x) for x in notice]
        made.append((i, "\n".join(lines[i % 3 :] + lines[: i % 3] + lines[: i // 15]), "en", "h", 0))
    made += [(100 + i, prose(rng, 60), "en", "h", 0) for i in range(70)] + [(200 + i, made[0][1], "en", "h", 0) for i in range(3)]
    assert len({r[1] for r in made}) == 100 and len({" ".join(sorted(set(r[1].lower().split()))) for r in made[:30]}) == 1
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    want = list(brute_quality(made))
    assert sum(v[6] > 0 for v, _ in want) == 33
    same([tuple(r) for r in line_quality.verdicts(line_quality.facts(df)).drop("rid", "places").collect()], [v for v, _ in want])
    same([(r.doc_id, r.text) for r in line_quality.clean(df).collect()], [(v[0], t) for v, t in want if v[8]])


def brute_classes(rows_, threshold=0.8):
    """(row, class number or None, links) for each row."""
    sets = []
    for r in rows_:
        w = WORD.findall(text(r))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows_)
    linked = [[i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
    return [(rows_[i], label[i] if sets[i] else None, sum(map(bool, linked[i]))) for i in range(n)]


def brute_links(rows_, threshold=0.8):
    found = brute_classes(rows_, threshold)
    least = {c: min((r[0] for r, x, _ in found if x == c and r[0] is not None), default=None) for _, c, _ in found}
    return [(r[0], r[0] if c is None else least[c], n) for r, c, n in found]


def brute_one_of_each(rows_):
    """The rows that stay: of each class that of the smallest id, null last; ties by text are left open."""
    groups = collections.defaultdict(list)
    for k, (r, c, _) in enumerate(brute_classes(rows_)):
        groups[("none", k) if c is None else c].append((r[0] is None, r[0] or 0, text(r)))
    return [{x for x in v if x[:2] == min(v)[:2]} for v in groups.values()]


def test_jaccard_join(docs, empty):
    assert jaccard_join.join(empty).count() == 0
    want = brute_links(ROWS)
    for options in ({}, {"block": 3}, {"block_grams": 200}):
        same([(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(docs, **options).collect()], want)


def test_jaccard_join_large_near_group(spark):
    rng = random.Random(1)
    base = prose(rng, 150).split(" ")
    made = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"w{rng.randrange(1000)}"
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = brute_links(made)
    for options in ({"block": 16}, {"block": 1}):
        same([(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(df, **options).collect()], want)
    # fewer bands lose the same pairs whatever the size of the blocks
    few = [sorted(tuple(r) for r in jaccard_join.join(df, recall=0.5, block=b).collect()) for b in (1024, 8)]
    assert few[0] == few[1] and 0.3 < sum(r[2] for r in few[0]) / sum(w[2] for w in want) < 1


def test_one_of_each(spark, docs):
    rng = random.Random(14)
    unrelated = [(i, prose(rng, 40)) for i in (5, 5, None, None)]
    near = [(7, unrelated[0][1]), (None, unrelated[2][1] + " end"), (5, unrelated[1][1]), (9, None), (9, None), (9, " ")]
    for made, df in ((ROWS, docs), (unrelated + near, spark.createDataFrame(unrelated + near, "doc_id long, text string"))):
        out = jaccard_join.one_of_each(df)
        assert out.columns == df.columns
        got = collections.Counter((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
        want = brute_one_of_each(made)
        assert sum(got.values()) == len(want)
        for one in want:  # each class has its row
            assert any(got[x] > 0 for x in one)
            got.subtract([next(x for x in one if got[x] > 0)])


def test_banding_reaches_its_recall():
    bands, rows_ = jaccard_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9999


def test_sizes_of_joins_are_those_of_stored_rows(spark, docs):
    """Catalyst multiplies both sides of a join; work is split by what the join really holds."""
    stored = shared.written(docs.select("doc_id", "text", "source"), "left")
    joined = stored.join(shared.written(docs.select("doc_id", F.col("text").alias("other")), "right"), "doc_id", "left").hint("shuffle_hash")
    kept = shared.written(joined, "joined")
    assert shared.plain_scan(stored.filter("doc_id > 3").select("text")) and not shared.plain_scan(joined)
    a, b = (Routing(x, 2000, 500) for x in (joined, kept))
    assert abs(a.buckets - b.buckets) <= 0.2 * b.buckets and a.partitions <= 1.2 * b.partitions
    assert shared.input_bytes(joined) < 20 * shared.input_bytes(kept)
    want = substring_dedup.remove_repeats(kept).collect()
    same(substring_dedup.remove_repeats(joined).collect(), want)
    same(suffix_dedup.remove_repeats(joined).collect(), suffix_dedup.remove_repeats(kept).collect())
    same(jaccard_join.join(joined).collect(), jaccard_join.join(kept).collect())
