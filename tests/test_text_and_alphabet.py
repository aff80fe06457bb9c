from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import charsets
from vellum.functions.text import blank, normalize_string, normalized, tokens, without
from vellum.operators import alphabet as alpha
from vellum.operators.alphabet import Alphabet, DuplicateSymbol


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_normal_form(spark):
    text = " a\t b    c\n\nd  e "
    assert one(spark, normalized, text) == normalize_string(text) == "a b c d e"
    assert one(spark, normalized, "ßæÆœŒﬆ") == "ssaeAEoeOEst"


def test_codes_from_a_string():
    text = "grün 42!\n\tnu"
    a = Alphabet.from_string(text)
    chars = sorted(set(" ".join(text.split())))
    assert a.codes == {alpha.NULL: 0, alpha.UNKNOWN: 1, **{c: k for k, c in enumerate(chars, 2)}, alpha.START: len(chars) + 2, alpha.END: len(chars) + 3}
    assert len(a) == len(chars) + 4 and a["z"] == a.get_code("z") == 1 and all(a[a[c]] == c for c in chars) and "g" in a and 99 not in a and not a.many_to_one


def test_codes_from_classes():
    classes = [["k", "K"], "q", ["é", "e", "E"], "7", ["x", "X"], "v"]
    a = Alphabet.from_classes(classes)
    order = sorted(sorted(c) for c in classes)
    assert all(a[s] == k for k, c in enumerate(order, 2) for s in c)
    assert a.get_symbol(a["e"]) == "E" and a.get_symbol(a["e"], all=True) == ["E", "e", "é"] and a.get_symbol(99) == "?"
    assert Alphabet.from_dict(a.to_dict()) == a and a.many_to_one
    assert a.to_list(["7", "K"]) == [["E", "e", "é"], ["X", "x"], "k", "q", "v"]
    assert a.stats() == {"symbols": 10, "codes": 6}
    with pytest.raises(DuplicateSymbol):
        Alphabet.from_classes([["p", "r"], ["r", "s"]])


def test_case_folding_and_merging():
    a = Alphabet.from_classes(["A", "a", "b", ["i", "í"], "j"], merge=["ij"], case_folding=True)
    assert a["A"] == a["a"] and a.get_symbol(a["A"]) == "a" and a["í"] == a["j"]
    assert alpha.merged([["i"], ["j"], ["k"]], ["ij", "jk"]) == [["i", "j", "k"]]
    assert alpha.grouped([["J", "Ĵ"], ["u", "ù", "ũ"], ["1"]], ["u", "ũ", "J", "%"]) == [["J"], ["u", "ũ"], ["%"]]


def test_set_operations():
    a, b = Alphabet.from_string("abc"), Alphabet.from_string("bcd")
    assert a.intersection(b) == {"b", "c", "ϵ", "?", "↦", "⇥"} and a.differences(b) == ({"a"}, {"d"})


def test_encode_and_decode(spark):
    a = Alphabet.from_string("mow ths→")
    plain = lambda t: [a[c] for c in " ".join(t.split())]
    for t in ("who most", " who\t  most ", "zoo", ""):
        assert one(spark, a.encode, t) == plain(t)
        assert one(spark, a.decode, plain(t), "array<int>") == "".join(c if c in a else "?" for c in " ".join(t.split()))
    assert [r.index(1) for r in one(spark, a.encode_one_hot, "mow")] == plain("mow")
    codes = plain("most →")
    for n in (3, F.lit(3)):
        assert one(spark, lambda c, n=n: a.decode(c, n), codes, "array<int>") == "mos"


def test_symbols_of_several_characters(spark):
    a = Alphabet.from_classes(["a", ["ch", "Ch"], "c", "h", "chr", ".", "a.b"])
    for text, symbols in (("chach", ["ch", "a", "ch"]), ("chrchh", ["chr", "ch", "h"]), ("a.ba.x", ["a.b", "a", ".", "x"]), ("Ch", ["Ch"]), ("", [])):
        assert one(spark, a.symbols, text) == symbols and one(spark, a.encode, text) == [a[s] for s in symbols]
    words = lambda c: F.split(c, " ")
    assert one(spark, lambda c: a.encode(c, tokenizer=words), "ch zz a.b") == [a["ch"], 1, a["a.b"]]
    assert one(spark, lambda c: Alphabet.from_string("ab").encode(c, tokenizer=words), "a b ab") == [2, 3, 1]


def test_batches(spark, tmp_path):
    a = Alphabet.from_string("abc")
    df = spark.createDataFrame([(1, "ab"), (1, "c"), (2, None), (None, "abc"), (None, "")], "k int, x string")
    got = sorted((r.k or 0, r.codes, r.length) for r in a.encode_batch(df, "x", ["k"]).collect())
    assert got == [(0, [0, 0, 0], 0), (0, [2, 3, 4], 3), (1, [2, 3], 2), (1, [4, 0], 1), (2, [], 0)]
    for name, t in (("one.gt.txt", "xy\n z"), ("two.gt.txt", "y!"), ("other.txt", "q")):
        (tmp_path / name).write_text(t)
    found = Alphabet.prototype_of_files(spark, f"{tmp_path}/*.gt.txt", [["x", "X"], ["z"]])
    assert set(found.codes) == {"x", "y", "z", "!", *alpha.VIRTUAL}
    assert sorted(map(tuple, alpha.repeated(spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["b", "a"],)], "g array<string>"), "g").collect())) == [("a", 2), ("b", 3)]


def test_collapse(spark):
    a, rng = Alphabet.from_string("dekr fu"), random.Random(5)
    for _ in range(20):
        frames = [rng.choice([0, a["d"], a["e"], a[" "], a["k"]]) for _ in range(rng.randint(0, 25))]
        want = "".join(a[f] for k, f in enumerate(frames) if f and (k == 0 or f != frames[k - 1]))
        assert one(spark, a.decode_ctc, frames, "array<int>") == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aäAbß?.;: ñ漢-", max_size=20), min_size=1, max_size=8))
def test_reduce_is_decode_of_encode(spark, texts):
    a = Alphabet.from_classes(charsets.standard())
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(a.reduce(F.col("x")), a.decode(a.encode(F.col("x"), normal=False))).collect()
    assert all(r[0] == r[1] for r in rows)


def test_charsets(spark):
    classes = charsets.latin()
    assert len(classes) == 62 and ["d", "ď", "ð", "đ"] in classes and ["U", *"ÙÚÛÜŨŪŬŮŰŲ"] in classes
    df = spark.createDataFrame([(1, " añb\n\tb c "), (2, "漢 b")], "id int, text string")
    found = alpha.charset(df, "text", ["id"])
    assert sorted(map(tuple, found.collect())) == sorted([(1, "a"), (1, "ñ"), (1, "b"), (1, "c"), (2, "漢"), (2, " "), (2, "b")])
    assert [tuple(r) for r in alpha.where_found(alpha.unexpected(found, charsets.standard()), "id").collect()] == [("漢", "2")]
    a = Alphabet.prototype(df, "text", charsets.standard())
    assert set(a.codes) == {"a", "b", "c", "ñ", "漢", " ", *alpha.VIRTUAL}
    assert {r.symbol: r.code for r in alpha.coded(found).collect()} == Alphabet.from_charset(set("añbc 漢"), [], many_to_one=False).codes


def test_small_functions(spark):
    assert one(spark, tokens, "a  b") == ["a", "", "b"]
    assert one(spark, lambda c: without(c, "ab"), "cabbage") == "cge"
    assert one(spark, blank, "  \n") is True and one(spark, blank, "x") is False and one(spark, blank, None) is True


def test_trie_takes_the_longest_from_the_left():
    rng = random.Random(3)

    def plain(text, symbols):
        out, i = [], 0
        while i < len(text):
            out.append(max((s for s in symbols if text.startswith(s, i)), key=len, default=text[i]))
            i += len(out[-1])
        return out

    mine = lambda trie, t: [x for lo, hi, s in trie.cut(t) for x in (*t[lo:hi], *([s] if s else []))]
    for k in range(3000):
        letters = "ab" if k % 2 else "abé👍"
        symbols = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 6))}
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert mine(alpha.Trie(symbols), text) == plain(text, symbols)
    # time follows the text, not the symbols: each of these would take minutes if places were looked at one by one
    began = time.monotonic()
    for symbols, text in (({"a" * 2000 + "b", "aa"}, "a" * 200_000), ({"".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(10_000)}, "fedcab " * 30_000)):
        assert "".join(mine(alpha.Trie(symbols), text)) == text
    assert time.monotonic() - began < 20


def test_many_compound_symbols(spark):
    rng = random.Random(5)
    compound = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 7))) for _ in range(10_000)})
    a = Alphabet.from_classes([*"abcd", *compound])
    texts = ["".join(rng.choice("abcdx ") for _ in range(300)) for _ in range(40)] + ["", None, "x", "a"]
    trie = alpha.Trie(compound)
    want = [None if t is None else [x for lo, hi, s in trie.cut(t) for x in (*t[lo:hi], *([s] if s else []))] for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(a.symbols(F.col("t")), a.encode(F.col("t"), normal=False)).collect()
    assert [r[0] for r in got] == want
    assert [r[1] for r in got] == [None if w is None else [a.codes.get(x, 1) for x in w] for w in want]
