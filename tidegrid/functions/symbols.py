"""Canonical form of instrument symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotes, brackets and blanks that may stand around a symbol.
AROUND = " \t\r\n \"'“”[]{}"
#: Marks that may stand between the base and the share class.
MARKS = "./,; _"


def canonical_symbol(c: Column | str) -> Column:
    """Upper case, without blanks, quotes or brackets around it, and ``-`` before the share class.

    Null stays null and a symbol of nothing but blanks or quotes becomes null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.upper(F.btrim(c, F.lit(AROUND)))
    return F.nullif(F.translate(bare, MARKS, "-" * len(MARKS)), F.lit(""))


def canonical_text(s: str) -> str:
    """The same rule for one Python string ('' where the expression gives null)."""
    return s.strip(AROUND).upper().translate(_TO_DASH)


_TO_DASH = {ord(m): "-" for m in MARKS}
