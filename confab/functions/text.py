"""Text expressions on built-in functions (JVM side)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utrim(x: Column | str) -> Column:
    """Strip Unicode white space at both ends (Spark's trim strips blanks only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def is_blank(x: Column | str) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(~_c(x).rlike(r"(?U)\S"), F.lit(True))


def match_key(x: Column | str) -> Column:
    """Lower case, without anything but word characters and white space, stripped (TXT-1)."""
    return utrim(F.regexp_replace(F.lower(_c(x)), r"(?U)[^\w\s]", ""))


def millis(x: Column | str) -> Column:
    """Seconds as whole milliseconds, halves away from zero."""
    return F.round(_c(x) * F.lit(1000.0)).cast("long")


def zip_shorter(a: Column | str, b: Column | str, left: str = "a", right: str = "b") -> Column:
    """Two arrays side by side, as long as the shorter one (JON-3)."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    return F.arrays_zip(F.slice(_c(a), 1, n).alias(left), F.slice(_c(b), 1, n).alias(right))


def plain(text: str) -> str:
    """Small letters without accents, for what runs in Python (TXT-5)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
