"""Text normal forms as Arrow UDFs: Spark has neither NFKC nor case folding.

Nulls stay null; an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = re.compile(r"\s+")
_QUESTION = re.compile(r"[\s，。！？,.!?]+")
_WORD = re.compile(r"\w+")


def py_normalized(text: str) -> str:
    """NFKC, NUL dropped, trimmed."""
    return unicodedata.normalize("NFKC", text).replace("\x00", "").strip()


def py_squeezed(text: str) -> str:
    """NFKC, trimmed, case folded, all white space removed."""
    if text.isascii():
        return "".join(text.casefold().split())
    return _SPACE.sub("", unicodedata.normalize("NFKC", text).strip().casefold())


def py_question(text: str) -> str:
    """Normal form of a question: squeezed, without ，。！？,.!?"""
    return _QUESTION.sub("", unicodedata.normalize("NFKC", text).strip().casefold())


def py_match_text(text: str) -> str:
    """Words of the case-folded text, joined by one space."""
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", text).casefold()))


def _udf(f):
    @F.pandas_udf(StringType())
    def on_series(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return on_series


def normalized(c: Column) -> Column:
    return _udf(py_normalized)(c)


def squeezed(c: Column) -> Column:
    return _udf(py_squeezed)(c)


def canonical_question(c: Column) -> Column:
    return _udf(py_question)(c)


def match_text(c: Column) -> Column:
    return _udf(py_match_text)(c)


def fingerprint(c: Column) -> Column:
    """SHA-256 of the normalized text with runs of white space made one space; keeps case."""
    return F.sha2(F.regexp_replace(normalized(c), r"(?U)[\s\x1c-\x1f]+", " "), 256)
