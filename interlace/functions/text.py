"""Column functions on text whose meaning must not depend on ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank at the ends of a text.
BLANK = r"[\p{Z}\s\x{FEFF}\x{200B}]"


def strip(col: Column | str) -> Column:
    """Without blanks (of any script) at either end; null stays null."""
    return F.regexp_replace(col, f"(?U)^{BLANK}+|{BLANK}+$", "")


def blank(col: Column | str) -> Column:
    """True for null, empty and blank."""
    return F.coalesce(strip(col), F.lit("")) == ""
