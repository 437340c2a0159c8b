"""Symbols, headers and other text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The symbol alphabet and length.
SYMBOL_CHARS = "A-Z0-9._-"
SYMBOL_MAX = 10


def canonical_symbol(text: Column) -> Column:
    """Surrounding white space of any kind removed, upper case."""
    return F.upper(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""))


def is_symbol(canonical: Column) -> Column:
    """Whole-text match; ``\\z`` because Java's ``$`` lets a trailing newline through."""
    return F.coalesce(canonical.rlike(rf"\A[{SYMBOL_CHARS}]{{1,{SYMBOL_MAX}}}\z"), F.lit(False))


def lenient_symbol(text: Column) -> Column:
    """Upper case, foreign characters dropped, cut to ten; may come out empty."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return F.substring(F.regexp_replace(upper, f"[^{SYMBOL_CHARS}]", ""), 1, SYMBOL_MAX)


def plain_header(header: object) -> str:
    """``('Adj Close', 'X')`` or ``' Adj Close '`` becomes ``adj_close``."""
    top = header[0] if isinstance(header, tuple) else header
    return re.sub(" ", "_", str(top).strip().lower())
