"""Names as columns: white space, matching keys, lists of names in one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def match_key(c: Column) -> Column:
    """Key for matching names: lower case, no leading "the ", letters, digits and underscores only, single blanks."""
    s = F.regexp_replace(stripped(F.lower(c)), r"^the ", "")
    s = F.regexp_replace(s, r"(?U)[^\p{L}\p{N}_\s]", "")
    return stripped(F.regexp_replace(s, r"(?U)\s+", " "))


def filled(c: str) -> Column:
    """A name, or null where it is blank."""
    name = stripped(F.col(c))
    return F.when(name != "", name)


def joined_first(n: int, place: Column | str, text: Column) -> Column:
    """Aggregate: the texts of the first ``n`` places, in their order, joined by bars."""
    rows = F.sort_array(F.collect_list(F.when(F.col(place) <= n if isinstance(place, str) else place <= n, F.struct(F.col(place).alias("k") if isinstance(place, str) else place.alias("k"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "|")
