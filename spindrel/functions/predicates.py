"""Predicates (all tags and all closed ranges), selectivity bins and match-count bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    attr: str
    lo: int
    hi: int


@dataclass(frozen=True)
class Predicate:
    """A conjunction; empty means every live row."""

    tags: tuple[int, ...] = ()
    ranges: tuple[Range, ...] = ()


def has_all(tags, wanted) -> Column:
    """tags hold every wanted tag; an empty list of wanted tags is always held."""
    return F.size(F.array_except(wanted, tags)) == 0


def in_ranges(ranges) -> Column:
    """All closed ranges at once, so that the scan gets one conjunction to push down; inverted ranges hold nothing."""
    found = F.lit(True)
    for r in ranges:
        found = found & F.col(r.attr).between(r.lo, r.hi)
    return found


#: Upper edges of the selectivity bins (fixed values); the last bin holds 1.0 as well.
BIN_EDGES = (1e-4, 1e-3, 1e-2, 1e-1)
BIN_NAMES = ("<0.01%", "0.01-0.1%", "0.1-1%", "1-10%", ">10%")


def selectivity_bin(selectivity) -> Column:
    out = F.lit(len(BIN_EDGES))
    for i in range(len(BIN_EDGES) - 1, -1, -1):
        out = F.when(selectivity < BIN_EDGES[i], i).otherwise(out)
    return out


#: Quarter decades of the match count, 0 to 7.25 (fixed value).
MATCH_BINS = 29


def match_bin(matches) -> Column:
    return F.least(F.lit(MATCH_BINS - 1), F.floor(F.log10(F.greatest(matches, F.lit(1))) * 4)).cast("int")


def decade(n) -> Column:
    """0 for 0, then 1 for [1, 10), 2 for [10, 100) and so on."""
    return F.when(n < 1, 0).otherwise(F.floor(F.log10(F.greatest(n, F.lit(1)))) + 1).cast("int")
