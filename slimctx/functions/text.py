"""Text functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the identifier pattern used to decide which imports a symbol
# uses (applied to raw text, comments and strings included).
IDENT_RE = r"\b([A-Za-z_$][A-Za-z0-9_$]*)\b"


def lossy_utf8(content: Column) -> Column:
    """Bytes → text, invalid UTF-8 replaced by U+FFFD (never throws)."""
    return F.make_valid_utf8(content.cast("string"))


def heuristic_tokens(text: Column) -> Column:
    """``max(1, len(text) // 4)`` in code points."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


TokenExpr = Callable[[Column], Column]


def identifiers(text: Column) -> Column:
    """Distinct identifier-like tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENT_RE), 1))


def strip_quotes(s: Column) -> Column:
    """Remove one pair of matching quotes (double, single or backtick)."""
    return F.regexp_replace(s, r"""^(["'`])(.*)\1$""", "$2")


def rstrip_ws(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def strip_ws(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\s+$", ""), r"^\s+", "")


def split_names(s: Column) -> Column:
    """'a, b ,, c' → ['a','b','c'] (trim, drop empty)."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def symbols_from_prompt(prompt: Column) -> Column:
    """Symbol list from a chat prompt (``--symbols a,b`` / ``symbols= a,b``)."""
    raw = F.regexp_extract(prompt, r"(?:--symbols|symbols=)\s+?([A-Za-z0-9_,$\s]+)", 1)
    return split_names(raw)
