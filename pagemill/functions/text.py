"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (Unicode).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` alone removes only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_blank_lines(c: Column) -> Column:
    """Make every run of blank lines one blank line, and strip the ends."""
    return strip(F.regexp_replace(c, rf"\n{WS_CLASS}*\n", "\n\n"))
