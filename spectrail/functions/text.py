"""Names of dictionary rows, and numbers as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_simplex_row(name: Column) -> Column:
    """All dictionary rows count in a composition but those of low lines, whose element has a row of high lines."""
    return ~name.rlike("_low$")


def element_of(name: Column) -> Column:
    return F.regexp_replace(name, "_(low|high)$", "")


def band_of(name: Column) -> Column:
    """low, high or an empty text."""
    return F.regexp_extract(name, "_(low|high)$", 1)


def ordinal(value: Column) -> Column:
    """1 as 1st; a text that isn't a whole number stays as it is."""
    text = value.cast("string")
    n = F.abs(text.try_cast("bigint"))
    teens = (n % 100).between(11, 13)
    ending = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.concat(F.trim(text), ending)).otherwise(text)
