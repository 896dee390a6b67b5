"""Path and file-content predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.constants import BINARY_PROBE_BYTES, EXTENSIONS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    """Language by file extension, '' when unknown."""
    ext = extension(path)
    chain = F
    for language, extensions in EXTENSIONS.items():
        chain = chain.when(ext.isin(*extensions), F.lit(language))
    return chain.otherwise(F.lit(""))


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a glob where ``**`` spans separators."""
    words = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)
    return "^" + "".join(words.get(piece, re.escape(piece)) for piece in pieces) + "$"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def matches_any(path: Column, patterns) -> Column:
    """Whether any glob matches (F0). One alternation, so one regex pass per path."""
    if not patterns:
        return F.lit(False)
    combined = "|".join(f"(?:{glob_to_regex(p)})" for p in patterns)
    return F.regexp_replace(slashed(path), r"^\./", "").rlike(combined)


def is_binary(content: Column) -> Column:
    """A NUL byte near the start (P5)."""
    return F.contains(F.substring(content, 1, BINARY_PROBE_BYTES), F.lit(b"\0"))
