"""Character classes for building alphabets; characters of a class share a code, the first stands for it."""

from __future__ import annotations

import unicodedata

SPACE = [[" "]]
#: Members of Latin classes besides letters that decompose to the class's letter.
LATIN_EXTRAS = {
    "D": "ÐĐ", "d": "ðđ", "g": "ḡ", "H": "Ħ", "h": "ħ", "i": "ı", "J": "Ɉ", "j": "ɉ", "k": "ĸ", "L": "ĿŁ£", "l": "ŀł", "N": "Ŋ", "n": "ŉŋ", "o": "°",
    "P": "ꝐꝒ", "p": "ꝑꝓ", "Q": "ꝖꝘ", "q": "ꝗꝙ", "R": "ꝚꝜꝶ", "r": "ˀꝛꝝꝵ", "S": "ß", "s": "ſẜ", "T": "Ŧ", "t": "ŧꝷ", "V": "Ꝟ", "v": "ꝟ", "W": "Ẅ", "w": "ẅ",
    "Y": "ȲẎ", "y": "ȳẏẙ", "Z": "ẐƵƷȤ", "z": "ẑƶʒȥ",
}
#: Fixed values.
PUNCTUATION = [[".", "✳"], [",", ";", ":"], ["-", "¬", "—", "="], ["¶", "§"]]
PARENTHESES = [["(", ")", "[", "]", "{", "}", "/", "\\", "|"]]
ABBREVIATIONS = [[c] for c in ["*", "ƺ", "Ꝯ", "ꝯ", "Ꝫ", "ꝫ", "ȝ", "₰", "ꝰ", "ꝭ", "&", "₎", "Ꜿ", "\ufb3b"]]
SUPERSCRIPTS = [[chr(c) for c in (0x363, 0x368, 0x369, 0x364, 0x36A, 0x365, 0x36B, 0x366, 0x36C, 0x36D, 0x367, 0x36E, 0x36F)]]
DIACRITICS = [["'", "ʼ", *map(chr, range(0x300, 0x316)), "̡", "̢", "̧", "̨", "᷐"]]
HEBREW = [[chr(c)] for c in range(0x591, 0x5F5)]
GREEK = [[chr(c)] for c in (*range(0x3B1, 0x3E1), *range(0x391, 0x3B0))]


def latin() -> list[list[str]]:
    """Digits, and for each letter its class: the Latin-1 and Extended-A letters that decompose to it, and its extras."""
    marked: dict[str, list[str]] = {}
    for c in map(chr, range(0xC0, 0x180)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1:
            marked.setdefault(parts[0], []).append(c)
    letters = [x for c in range(26) for x in (chr(ord("A") + c), chr(ord("a") + c))]
    return [[d] for d in "0123456789"] + [[x, *marked.get(x, []), *LATIN_EXTRAS.get(x, "")] for x in letters]


def standard() -> list[list[str]]:
    """All classes; a character in two of them is an error."""
    classes = [*SPACE, *latin(), *PUNCTUATION, *SUPERSCRIPTS, *DIACRITICS, *PARENTHESES, *ABBREVIATIONS, *HEBREW, *GREEK]
    seen: set[str] = set()
    for c in (c for group in classes for c in group):
        if c in seen:
            raise ValueError(f"{c!r} is in two classes")
        seen.add(c)
    return classes
