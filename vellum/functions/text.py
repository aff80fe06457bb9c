"""Text functions: normal form, tokens, rewriting."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ligatures are written as.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
BLANKS = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode normal form KC; Spark has no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def squeezed(text: Column) -> Column:
    """Ends stripped and runs of any Unicode blanks made one space."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def unligatured(text: Column) -> Column:
    for k, v in LIGATURES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def normalized(text: Column) -> Column:
    """squeezed and unligatured text in normal form KC."""
    return nfkc(unligatured(squeezed(text)))


def normalize_string(text: str) -> str:
    """normalized() for one string on the driver."""
    text = re.sub(r"\s+", " ", text).strip()
    for k, v in LIGATURES.items():
        text = text.replace(k, v)
    return unicodedata.normalize("NFKC", text)


def characters(text: Column) -> Column:
    """The code points of a text; none for an empty text, where split() would give one empty string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def tokens(text: Column, separator: str = " ") -> Column:
    """Parts between separators; neighbouring separators give empty parts."""
    return F.split(text, re.escape(separator)) if separator else characters(text)


def without(text: Column, ignored: str) -> Column:
    """Text without the given characters."""
    return F.translate(text, ignored, "") if ignored else text


def blank(text: Column) -> Column:
    """Missing, empty, or only Unicode blanks."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")
