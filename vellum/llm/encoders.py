"""Encoders of whole texts for three public tokenizer formats, over distinct units of text.

A unit is a stretch of bytes whose ids do not depend on what stands around it.  Each batch of texts is cut
into units, the distinct ones are encoded, and each text's ids are gathered from theirs.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellum.llm.flat import BLANK, flat, gather, strings
from vellum.llm.merges import Merges, merge_rounds

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of many texts: encode() returns (flat ids, offsets of texts)."""

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = self.prepare(column)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        first, odd = self.cuts(raw, offsets)
        first[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(first)
        if odd is not None:
            keep = odd[starts] >= 0
            raw, offsets, starts = self.compact(raw, offsets, starts, odd, keep)
        units = strings(raw, starts, len(raw)).dictionary_encode()
        which = units.indices.to_numpy()
        ids, sizes = self.distinct(units.dictionary)
        lengths = sizes[which]
        at = np.append(0, np.cumsum(lengths))[np.searchsorted(starts, offsets)]
        return ids[gather((np.cumsum(sizes) - sizes)[which], lengths)], at

    def prepare(self, column):
        return flat(column)

    @staticmethod
    def compact(raw, offsets, starts, odd, keep):
        """Drops units that no token covers."""
        ends = np.append(starts[1:], len(raw))
        index = gather(starts[keep], (ends - starts)[keep])
        before = np.append(0, np.cumsum((ends - starts) * keep))
        at = np.searchsorted(starts, offsets)
        return raw[index], before[at], before[:-1][keep]


class PieceEncoder(Encoder):
    """A sentencepiece BPE model with byte fallback, an identity normaliser and no removal of blanks.

    Merges can only cross two neighbouring characters that some piece holds next to each other; texts are cut at
    all other places.  Begin and end ids are not added here.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        m = model.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, spec = m.normalizer_spec, m.trainer_spec
        if spec.model_type != 2 or not spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("this encoder takes BPE models with byte fallback and the identity normaliser")
        self.prefix, self.begin, self.end = n.add_dummy_prefix, spec.bos_id, spec.eos_id
        self.size = len(m.pieces)
        pieces = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.bytes_ = np.zeros(256, np.int64)
        out = [b""] * self.size
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes_[int(p.piece[3:5], 16)] = i
                out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                out[i] = p.piece.replace("▁", " ").encode()
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out])
        self.char = np.full(0x110000, -1, np.int64)  # a single character's id, or its code point after all ids
        for c, i in pieces.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.char = np.where(self.char < 0, self.size + np.arange(0x110000), self.char)
        self.char[0x20] = self.char[0x2581]
        name = lambda x: pieces.get(x) if len(x) > 1 else int(self.char[ord(x)])
        scores = sorted({-m.pieces[i].score for i in pieces.values()})
        rank = {s: r for r, s in enumerate(scores)}
        self.joins = np.zeros((256, 256), bool)
        self.joins[128:, :] = self.joins[:, 128:] = True
        left, right, ranks, merged = [], [], [], []
        for p, i in pieces.items():
            ascii_ = p.replace("▁", " ")
            for a, b in zip(ascii_, ascii_[1:], strict=False):
                if ord(a) < 128 and ord(b) < 128:
                    self.joins[ord(a), ord(b)] = True
            for k in range(1, len(p)):
                if (x := name(p[:k])) is not None and (y := name(p[k:])) is not None:
                    left.append(x), right.append(y), ranks.append(rank[-m.pieces[i].score]), merged.append(i)
        self.merges = Merges(left, right, ranks, merged, self.size + 0x110000)

    def prepare(self, column):
        column = column.fill_null("") if column.null_count else column
        column = pc.replace_substring(column, "▁", " ")
        if self.prefix:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))
        return flat(column)

    def cuts(self, raw, offsets):
        first = np.ones(len(raw), bool)
        first[1:] = ~self.joins[raw[:-1], raw[1:]]
        return first, None

    def distinct(self, units):
        raw, at = flat(units)
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        head = np.append(np.cumsum((raw & 0xC0) != 0x80), 0)
        before = np.where(at > 0, head[np.maximum(at, 1) - 1], 0)
        sym, sizes = merge_rounds(self.merges, self.char[chars], np.diff(before))
        if (rare := np.flatnonzero(sym >= self.size)).size:  # characters without a piece: their bytes
            text = [chr(c).encode("utf-8", "surrogatepass") for c in sym[rare] - self.size]
            n = np.ones(len(sym), np.int64)
            n[rare] = [len(x) for x in text]
            word = np.repeat(np.arange(len(sizes)), sizes)
            sizes = np.bincount(word, weights=n, minlength=len(sizes)).astype(np.int64)
            sym = np.repeat(sym, n)
            sym[sym >= self.size] = self.bytes_[np.frombuffer(b"".join(text), np.uint8)]
        return sym, sizes

    def framed(self, column) -> tuple[np.ndarray, np.ndarray]:
        """encode() with the begin and the end id around each text."""
        ids, at = self.encode(column)
        n = np.diff(at)
        out = np.full(len(ids) + 2 * len(n), self.begin, np.int64)
        where = np.append(0, np.cumsum(n + 2))
        out[gather(where[:-1] + 1, n)] = ids
        out[where[1:] - 1] = self.end
        return out, where

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of framed ids as (bytes, offsets).  A text loses the one blank that the encoder put before it."""
        n = self.out_size[ids]
        raw = self.out[gather((np.cumsum(self.out_size) - self.out_size)[ids], n)]
        to = np.append(0, np.cumsum(n))[at]
        if self.prefix:
            lo, hi = to[:-1], to[1:]
            drop = lo[(lo < hi) & (raw[np.minimum(lo, max(len(raw) - 1, 0))] == 0x20)] if len(raw) else lo[:0]
            keep = np.ones(len(raw), bool)
            keep[drop] = False
            to = np.append(0, np.cumsum(keep))[to]
            raw = raw[keep]
        return raw, to


#: Kinds of bytes for the two formats below: blank, letter, number, other, or one that only the library judges.
W, L, N, O, X = range(5)
KIND = np.full(256, O, np.uint8)
KIND[BLANK] = W
KIND[[0x1C, 0x1D, 0x1E, 0x1F, 0x00, 0x7F]] = X
KIND[ord("0") : ord("9") + 1] = N
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = L
KIND[128:] = X
KIND[0x27] = X  # contractions


def kinds(raw: np.ndarray) -> np.ndarray:
    """The letters of Latin-1 count as letters; other characters beyond ASCII are left to the library."""
    kind = KIND[raw]
    if (lead := np.flatnonzero(raw == 0xC3)).size:
        lead = lead[(lead + 1 < len(raw))]
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = L
    return kind


class VocabularyEncoder(Encoder):
    """A tokenizer file of the tokenizers library: byte-pair merges within words of a regular expression.

    Words of ASCII and Latin-1 letters, digits and signs are found and merged here in bulk; a stretch with
    anything else (other scripts, apostrophes, the texts of special tokens) goes to the library itself.
    The ids are the library's for every text.
    """

    def __init__(self, path: str, strip: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.strip = strip  # blanks are dropped, letters lowered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.tail = model.get("end_of_word_suffix") or ""
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("this encoder takes plain merges")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)])
        self.final = np.array([vocab[letter[b] + self.tail] for b in range(256)])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        first: dict = {}
        for r, (a, b) in enumerate(pairs):
            first.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        rank = [r for r, _ in first.values()]
        self.merges = Merges([a for a, _ in first], [b for _, b in first], rank, [m for _, m in first.values()], max(vocab.values()) + 1)
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def cuts(self, raw, offsets):
        n = len(raw)
        kind = kinds(raw)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin = edge[:n]
        bad = kind == X
        text = None
        for mark in self.marks:  # special tokens are found in the text as it is
            if (raw == mark[0]).any() and mark in (text := text or raw.tobytes()):
                at = -1
                while (at := text.find(mark, at + 1)) >= 0:
                    bad[at : at + len(mark)] = True
        blank = kind == W
        after = np.append(kind[1:], W)
        after[edge[1:]] = W
        # places where a stretch that the library judges may begin and end
        if self.strip:
            safe = blank.copy()
            safe[1:] |= blank[:-1]
        else:
            safe = (raw == 0x20) & (after != W) & (after != X)
        safe |= begin
        if bad.any():
            at = np.flatnonzero(safe)
            odd_stretch = np.logical_or.reduceat(bad, at)
            odd_byte = np.repeat(odd_stretch, np.diff(np.append(at, n)))
        else:
            at, odd_stretch, odd_byte = np.flatnonzero(safe), np.zeros(0, bool), np.zeros(n, bool)
        prev = np.empty(n, np.uint8)
        prev[0] = W
        prev[1:] = kind[:-1]
        prev[begin] = 9
        if self.strip:
            first = (kind != prev) | (kind == N)
        else:
            # of several blanks the last stands apart unless the text ends; a space joins what follows it
            alone = blank & (after != W)
            joined = np.zeros(n, bool)
            joined[1:] = alone[:-1] & (raw[:-1] == 0x20)
            joined &= ~begin
            first = ((kind != prev) & ~joined) | (alone & ~begin)
        first &= ~odd_byte
        first |= begin
        if len(odd_stretch):
            first[at] |= odd_stretch
            tail = np.append(at[1:], n)[odd_stretch]
            first[tail[tail < n]] = True
        continuing = (raw & 0xC0) == 0x80
        first &= ~continuing | odd_byte | begin
        if not self.strip:
            return first, None
        # lower the rest, and drop blanks
        lowered = np.where(odd_byte, raw, self.lower[raw])
        upper = ~odd_byte & continuing & (raw < 0x9F)
        upper[1:] &= raw[:-1] == 0xC3
        lowered[upper] += 0x20
        self.lowered = lowered
        drop = np.where(blank & ~odd_byte, -1, 0).astype(np.int8)
        return first, drop

    def compact(self, raw, offsets, starts, odd, keep):
        return Encoder.compact(self.lowered, offsets, starts, odd, keep)

    def distinct(self, units):
        raw, at = flat(units)
        kind = kinds(raw)
        bad = kind == X
        sizes = np.diff(at)
        odd = np.logical_or.reduceat(bad, at[:-1]) if len(raw) else np.zeros(0, bool)
        if any((raw == m[0]).any() for m in self.marks):
            odd |= np.array([any(m in u for m in self.marks) for u in units.to_pylist()], bool)
        good = ~odd
        index = gather(at[:-1][good], sizes[good])
        sym = self.inner[raw[index]]
        ends = np.cumsum(sizes[good]) - 1
        if self.tail:
            sym[ends] = self.final[raw[index][ends]]
        sym, n = merge_rounds(self.merges, sym, sizes[good])
        if not odd.any():
            return sym, n
        text = [x.decode() for x in units.filter(pa.array(odd)).to_pylist()]
        extra = [e.ids for e in self.library.encode_batch(text, add_special_tokens=False)]
        total = np.zeros(len(sizes), np.int64)
        total[good], total[odd] = n, [len(x) for x in extra]
        out = np.empty(int(total.sum()), np.int64)
        start = np.cumsum(total) - total
        out[gather(start[good], n)] = sym
        out[gather(start[odd], total[odd])] = [i for x in extra for i in x]
        return out, total


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file in each Python worker."""
    if path.endswith(".model"):
        return PieceEncoder(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    strip = "Lowercase" in json.dumps(spec.get("normalizer"))
    return VocabularyEncoder(path, strip)


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends an id to each text."""
    n = np.diff(at)
    to = np.append(0, np.cumsum(n + 1))
    out = np.full(len(ids) + len(n), end, np.int64)
    out[gather(to[:-1], n)] = ids
    return out, to


__all__ = ["Encoder", "PieceEncoder", "VocabularyEncoder", "encoder", "tokenizer_path", "with_end"]
