"""Labels that are spelled in several ways: sources, languages, tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(c: Column) -> Column:
    """Source as in the clean list: trimmed, lower case, '-' for '_' and blanks. Null stays null."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")


def language_key(c: Column) -> Column:
    """Primary subtag of a language tag, lower case: en-US -> en, zh_CN -> zh. Blank is null."""
    tag = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)
