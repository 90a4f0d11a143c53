"""Text cleanup expressions with Python ``str`` semantics."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() holds;
# Spark's trim() only removes spaces.  Build the same character set by rule.
WHITESPACE_CODES = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODES)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(s) -> Column:
    """``str.strip()``: trim all Unicode whitespace at both ends."""
    return F.btrim(_c(s), F.lit(WHITESPACE))


def stripped_length(s) -> Column:
    return F.char_length(py_strip(s))


def title_words(s) -> Column:
    """``s.replace('_', ' ').title()`` for ASCII identifiers such as ``p50_ms``.

    Python's title() upper-cases the first letter after any non-letter, so
    ``p50_ms`` becomes ``P50 Ms``; ``initcap`` only looks at spaces, which is
    the same thing once ``_`` is replaced and the words start with a letter.
    """
    return F.initcap(F.regexp_replace(_c(s), "_", " "))


def whitespace_sql_literal() -> str:
    """The same character set as a SQL expression (``chr(..)||chr(..)``)."""
    return "||".join(f"chr({c})" for c in WHITESPACE_CODES)
