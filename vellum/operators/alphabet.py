"""Alphabets: symbols to codes (one-to-one or many-to-one), and the columns that encode, decode and reduce with them.

An alphabet is small and lives on the driver; it compiles to map literals and to translate() strings, so that texts are
processed without joins or shuffles.  Prototypes come from the distinct characters of a corpus, which the cluster counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import nested
from vellum.functions.text import characters, normalize_string, normalized

#: Fixed values.
NULL, UNKNOWN, START, END = "ϵ", "?", "↦", "⇥"
NULL_CODE, UNKNOWN_CODE, FIRST_CODE = 0, 1, 2
#: Where encode() puts codes on their way: a private area of Unicode.
BASE = 0xE000
VIRTUAL = (NULL, UNKNOWN, START, END)


class DuplicateSymbol(ValueError):
    """A symbol stands in two classes."""


@dataclass(frozen=True)
class Alphabet:
    """codes: symbol -> code.  A code's representative is its smallest symbol (in lower case with case_folding)."""

    codes: dict[str, int]
    case_folding: bool = False

    # construction

    @classmethod
    def from_string(cls, text: str) -> Alphabet:
        """One code for each distinct character of the normalised text."""
        return cls.from_classes(sorted(set(normalize_string(text))))

    @classmethod
    def from_classes(cls, classes: Sequence[str | Sequence[str]], merge: Sequence[str] = (), case_folding: bool = False) -> Alphabet:
        """A code for each class, in order of the classes' smallest symbols; a plain string is a class of one symbol."""
        groups = [[c] if isinstance(c, str) else list(c) for c in classes]
        if twice := duplicates(groups):
            raise DuplicateSymbol(f"in more than one class: {twice}")
        if case_folding:
            merge = [*merge, *(chr(c) + chr(c).lower() for c in range(ord("A"), ord("Z") + 1))]
        groups = merged(groups, merge)
        groups = sorted((sorted(s for s in g if s not in VIRTUAL and (s == " " or not s.isspace())) for g in groups), key=lambda g: g[:1])
        codes = {s: k for k, g in enumerate((g for g in groups if g), FIRST_CODE) for s in g}
        codes |= {NULL: NULL_CODE, UNKNOWN: UNKNOWN_CODE}
        for s in (START, END):
            codes[s] = max(codes.values()) + 1
        return cls(codes, case_folding)

    @classmethod
    def from_dict(cls, stored: dict) -> Alphabet:
        """The inverse of to_dict()."""
        return cls.from_classes(stored["list"], case_folding=stored["case_folding"])

    @classmethod
    def from_charset(cls, found: Iterable[str], standard: Sequence[str | Sequence[str]], merge: Sequence[str] = (), many_to_one: bool = True) -> Alphabet:
        """An alphabet of the characters found, grouped as in the standard classes; blanks other than the space are dropped."""
        chars = sorted(c for c in set(found) if c == " " or not c.isspace())
        return cls.from_classes(merged(grouped(standard, chars) if many_to_one else [[c] for c in chars], merge))

    @classmethod
    def prototype_of_files(cls, spark: SparkSession, glob: str, standard: Sequence[str | Sequence[str]], merge: Sequence[str] = (), many_to_one: bool = True) -> Alphabet:
        """prototype() of all text files whose paths match a pattern; none is an error."""
        return cls.prototype(spark.read.text(glob).withColumnRenamed("value", "text"), "text", standard, merge, many_to_one)

    @classmethod
    def prototype(cls, texts: DataFrame, column: str, standard: Sequence[str | Sequence[str]], merge: Sequence[str] = (), many_to_one: bool = True) -> Alphabet:
        """from_charset() of all lines of a corpus, ends stripped.  Only its distinct characters reach the driver (at most one for each code point)."""
        return cls.from_charset([r[0] for r in charset(texts, column).collect()], standard, merge, many_to_one)

    # contents

    @property
    def representatives(self) -> dict[int, str]:
        out: dict[int, str] = {}
        for s, c in sorted(self.codes.items()):
            out.setdefault(c, s.lower() if self.case_folding and c >= FIRST_CODE else s)
        return out

    @property
    def many_to_one(self) -> bool:
        return len(set(self.codes.values())) < len(self.codes)

    def __len__(self) -> int:
        return len(set(self.codes.values()))

    def __contains__(self, x: str | int) -> bool:
        return x in self.codes if isinstance(x, str) else x in self.codes.values()

    def __getitem__(self, x: str | int) -> int | str:
        return self.get_code(x) if isinstance(x, str) else self.get_symbol(x)

    def get_code(self, symbol: str) -> int:
        return self.codes.get(symbol, UNKNOWN_CODE)

    def get_symbol(self, code: int, all: bool = False) -> str | list[str]:  # noqa: A002
        """A code's representative (`?` if there is no such code), or all its symbols."""
        return sorted(s for s, c in self.codes.items() if c == code) if all else self.representatives.get(code, UNKNOWN)

    def to_list(self, exclude: Sequence[str] = ()) -> list[str | list[str]]:
        """The classes without virtual and excluded symbols; classes of one symbol as plain strings."""
        groups: dict[int, list[str]] = {}
        for s, c in sorted(self.codes.items()):
            if s not in VIRTUAL and s not in exclude:
                groups.setdefault(c, []).append(s)
        return sorted((g[0] if len(g) == 1 else g for g in groups.values()), key=lambda g: g[0])

    def to_dict(self) -> dict:
        return {"list": self.to_list(), "case_folding": self.case_folding}

    def reduced_codes(self) -> dict[str, int]:
        """Representatives and codes without start and end of sequence."""
        return {s: c for c, s in sorted(self.representatives.items()) if s not in (START, END)}

    def stats(self) -> dict[str, int]:
        """Numbers of symbols and codes, the four virtual ones not counted."""
        return {"symbols": len(set(self.codes) - set(VIRTUAL)), "codes": len(self) - len(VIRTUAL)}

    def intersection(self, other: Alphabet) -> set[str]:
        return set(self.codes) & set(other.codes)

    def differences(self, other: Alphabet) -> tuple[set[str], set[str]]:
        return set(self.codes) - set(other.codes), set(other.codes) - set(self.codes)

    def table(self, spark: SparkSession) -> DataFrame:
        """(symbol, code, repr), by symbol."""
        of = self.representatives
        return spark.createDataFrame([(s, c, of[c]) for s, c in sorted(self.codes.items())], "symbol string, code int, repr string")

    # columns

    def _translated(self, text: Column, of: dict[str, str], unknown: str) -> Column:
        """Characters replaced as in `of`, all others with `unknown`: one translate() that also lists the row's other characters.

        Where some characters stay as they are, texts of such ones up to U+00FF alone are not translated, and those of known ones have no others: a class of these, one by one, is a table to
        the regular expression, while each range costs time for each character.
        """
        known = "".join(of)
        other = F.array_join(F.array_distinct(characters(F.translate(text, known, ""))), "")
        near = [s for s in of if ord(s) < 256]
        same = [s for s in near if of[s] == s]
        beyond = lambda symbols: text.rlike("[^" + "".join(f"\\x{{{ord(s):x}}}" for s in symbols) + "]")
        if same:
            other = F.when(~beyond(near), F.lit("")).otherwise(other)
        moved = F.call_function("translate", text, F.concat(F.lit(known), other), F.concat(F.lit("".join(of.values())), F.repeat(F.lit(unknown), F.length(other))))
        return F.when(~beyond(same), text).otherwise(moved) if same else moved

    def symbols(self, text: Column) -> Column:
        """The text cut into symbols: at each place the longest symbol of several characters that begins there, else one character."""
        long = {s: c for s, c in self.codes.items() if len(s) > 1}
        return _cut(text, long, "array<string>", lambda t, found: [x for lo, hi, s in found for x in (*t[lo:hi], *([s] if s else []))]) if long else characters(text)

    def encode(self, text: Column, normal: bool = True, tokenizer: Callable[[Column], Column] | None = None) -> Column:
        """array<int> of codes; unknown symbols get 1.  normal: bring the text to its normal form first.

        tokenizer: a function from a column of texts to one of arrays of symbols; without one a text is cut by symbols().
        Characters are first moved to code points from BASE on, by code, whose numbers are then read off.  Alphabets with symbols of several characters find
        these by an automaton, in time that does not depend on how many there are; symbols of a tokenizer are looked up in a map.
        """
        if tokenizer is not None:
            table = F.create_map(*(F.lit(x) for s, c in sorted(self.codes.items()) for x in (s, c)))
            return F.transform(tokenizer(normalized(text) if normal else text), lambda s: F.coalesce(F.try_element_at(table, s), F.lit(UNKNOWN_CODE)))
        if long := {s: c for s, c in self.codes.items() if len(s) > 1}:
            one = {s: c for s, c in self.codes.items() if len(s) == 1}
            codes = lambda t, found: [x for lo, hi, s in found for x in (*(one.get(c, UNKNOWN_CODE) for c in t[lo:hi]), *([long[s]] if s else []))]
            return _cut(normalized(text) if normal else text, long, "array<int>", codes)
        of = {s: chr(BASE + c) for s, c in self.codes.items() if len(s) == 1}
        moved = self._translated(normalized(text) if normal else text, of, chr(BASE + UNKNOWN_CODE))
        return F.transform(characters(moved), lambda c: F.ascii(c) - BASE)

    def encode_batch(self, df: DataFrame, text: str, batch: Sequence[str], normal: bool = True) -> DataFrame:
        """df with codes, filled with null codes up to the longest of the row's batch, and their own length; a null text is empty."""
        rows = df.withColumn("codes", self.encode(F.coalesce(F.col(text), F.lit("")), normal)).withColumn("length", F.size("codes"))
        widest = rows.groupBy(*batch).agg(F.max("length").alias("_width"))
        rows = rows.join(widest.select(*(F.col(c).alias(f"_{c}") for c in batch), "_width"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in batch])
        return rows.withColumn("codes", nested.padded(F.col("codes"), F.col("_width"), NULL_CODE)).select(*df.columns, "codes", "length")

    def encode_one_hot(self, text: Column) -> Column:
        return nested.one_hot(self.encode(text), len(self))

    def decode(self, codes: Column, length: Column | int = -1) -> Column:
        """Text of codes, of the first `length` if that is not negative; unknown codes give `?`."""
        of = self.representatives
        table = F.array(*(F.lit(of.get(c, UNKNOWN)) for c in range(max(of) + 1)))
        if not isinstance(length, int):
            codes = F.when(length >= 0, F.slice(codes, F.lit(1), F.greatest(length, F.lit(0)))).otherwise(codes)
        elif length >= 0:
            codes = F.slice(codes, 1, length)
        return F.array_join(F.transform(codes, lambda c: F.coalesce(F.get(table, c), F.lit(UNKNOWN))), "")

    def decode_ctc(self, labels: Column) -> Column:
        """Text of frame labels: repeated neighbours count once, null labels not at all."""
        return self.decode(collapsed(labels))

    def reduce(self, text: Column) -> Column:
        """Each character replaced with its class's representative, unknown ones with `?`; representatives of several characters stay as their symbols."""
        of = self.representatives
        single = {s: of[c] if len(of[c]) == 1 else s for s, c in self.codes.items() if len(s) == 1}
        return self._translated(text, single, UNKNOWN)


class Trie:
    """Strings of several characters as a trie with failure links, in flat tables, read backwards.

    Reading a text from its end, the state is the longest part read that some string ends with, so the longest string of the state is the
    longest that begins at this place of the text: one pass, whatever the strings; a second one from the left takes them.
    """

    def __init__(self, strings: Iterable[str]):
        self.after: list[dict[str, int]] = [{}]
        depth, ends = [0], [False]
        for s in strings:
            at = 0
            for c in reversed(s):
                if c not in self.after[at]:
                    self.after[at][c] = len(self.after)
                    self.after.append({}), depth.append(depth[at] + 1), ends.append(False)
                at = self.after[at][c]
            ends[at] = True
        # by breadth: where to go on when a character does not follow, and the length of the longest string that the state ends with
        self.fail, self.longest = [0] * len(depth), [0] * len(depth)
        queue = [0]
        for at in queue:
            for c, to in self.after[at].items():
                queue.append(to)
                if at:
                    back = self.fail[at]
                    while back and c not in self.after[back]:
                        back = self.fail[back]
                    self.fail[to] = self.after[back].get(c, 0)
                self.longest[to] = depth[to] if ends[to] else self.longest[self.fail[to]]

    def cut(self, text: str) -> list[tuple[int, int, str | None]]:
        """(lo, hi, string): the longest string from the left at a time; places lo to hi before it are single characters, and the last part has no string."""
        at, found = 0, []
        for i in range(len(text) - 1, -1, -1):
            c = text[i]
            while at and c not in self.after[at]:
                at = self.fail[at]
            at = self.after[at].get(c, 0)
            if self.longest[at]:
                found.append((i, self.longest[at]))
        out, lo = [], 0
        for i, n in reversed(found):
            if i >= lo:
                out.append((lo, i, text[i : i + n]))
                lo = i + n
        out.append((lo, len(text), None))
        return out


def _cut(text: Column, long: dict[str, int], kind: str, made: Callable) -> Column:
    """made(text, its Trie.cut()) of each text as a column; null for null."""
    held: list[Trie] = []  # one for each worker's function

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Trie(long))
        return pa.array([None if t is None else made(t, held[0].cut(t)) for t in column.to_pylist()], pa.list_(pa.string() if "string" in kind else pa.int32()))

    return run(text)


def ranges(symbols: Iterable[str]) -> str:
    """The inside of a regular expression's character class for these characters: neighbours as ranges, since each part costs time for each character."""
    out: list[list[int]] = []
    for c in sorted(map(ord, symbols)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def collapsed(labels: Column, null: int = NULL_CODE) -> Column:
    """Frame labels without nulls and without those equal to the one before."""
    return F.filter(labels, lambda v, i: (v != null) & ((i == 0) | (v != F.get(labels, i - 1))))


def own_codes(text: Column, null: str = NULL) -> Column:
    """array<(symbol, code)>: a text's own alphabet, its distinct characters by code point from 1, and the null symbol as 0 unless the text holds it."""
    found = F.array_sort(F.array_distinct(characters(text)))
    codes = F.transform(found, lambda s, i: F.struct(s.alias("symbol"), (i + 1).cast("int").alias("code")))
    first = F.array(F.struct(F.lit(null).alias("symbol"), F.lit(0).alias("code")))
    return F.when(F.array_contains(found, null), codes).otherwise(F.concat(first, codes))


def duplicates(groups: Sequence[Sequence[str]]) -> list[str]:
    return sorted(s for s, n in Counter(s for g in groups for s in g).items() if n > 1)


def repeated(classes: DataFrame, symbols: str) -> DataFrame:
    """(symbol, n): symbols that stand more than once in a column of classes, and how often."""
    return classes.select(F.explode(symbols).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merged(groups: Sequence[Sequence[str]], merge: Sequence[str]) -> list[list[str]]:
    """Classes joined that hold characters of the same merge string; later strings see the earlier joins."""
    out = [list(g) for g in groups]
    for m in merge:
        hit = [g for g in out if set(g) & set(m)]
        if len(hit) > 1:
            out = [g for g in out if g not in hit] + [sorted({s for g in hit for s in g})]
    return out


def grouped(standard: Sequence[str | Sequence[str]], atoms: Iterable[str]) -> list[list[str]]:
    """The standard classes cut down to the atoms, and a class of its own for each atom that is in none."""
    left = dict.fromkeys(atoms)
    out = []
    for group in standard:
        if found := [s for s in group if s in left]:
            out.append(found)
            for s in found:
                del left[s]
    return out + [[s] for s in left]


def charset(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., symbol): distinct characters of the texts' lines, ends stripped; blanks other than spaces left out.

    Each row gives its distinct characters before they are exploded, so that at most the size of the charset leaves it.
    """
    lines = F.transform(F.split(column, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    symbols = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.array_distinct(characters(x)))))
    return texts.select(*keys, F.explode(symbols).alias("symbol")).filter((F.col("symbol") == " ") | ~F.col("symbol").rlike(r"(?U)\s")).distinct()


def unexpected(found: DataFrame, standard: Sequence[str | Sequence[str]]) -> DataFrame:
    """Rows of a charset() whose symbol is in no standard class."""
    known = sorted({s for g in standard for s in g})
    return found.filter(~F.col("symbol").isin(known))


def where_found(found: DataFrame, key: str) -> DataFrame:
    """(symbol, found_in): the sorted places of each symbol of a charset() with keys."""
    return found.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set(key)), ",").alias("found_in"))


def coded(found: DataFrame) -> DataFrame:
    """(symbol, code) of a one-to-one alphabet of a charset, virtual symbols included; the charset is bounded by Unicode."""
    from pyspark.sql import Window

    codes = found.select("symbol").distinct().select("symbol", (F.dense_rank().over(Window.orderBy("symbol")) + FIRST_CODE - 1).cast("long").alias("code"))
    last = codes.agg(F.coalesce(F.max("code"), F.lit(FIRST_CODE - 1)).alias("m"))
    extra = last.select(F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), c.cast("long").alias("code")) for s, c in ((NULL, F.lit(0)), (UNKNOWN, F.lit(1)), (START, F.col("m") + 1), (END, F.col("m") + 2))))).alias("x")).select("x.*")
    return codes.filter(~F.col("symbol").isin(*VIRTUAL)).unionByName(extra)
