"""Filters as predicates on stored columns, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.model import EntryType, Filters

_LONG = (1 << 63) - 1


def moment(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def predicate(filters: Filters) -> Column:
    parts = [F.lit(True)]
    if filters.extension is not None:
        parts.append((F.col("extension") == filters.extension) if filters.extension else F.lit(False))
    if filters.entry_type is not None:
        parts.append(F.col("is_dir") if filters.entry_type is EntryType.DIRECTORY else ~F.col("is_dir"))
    if filters.path_contains:
        parts.append(F.col("path_lower").contains(filters.path_contains.lower()))
    # sizes are signed longs; bounds beyond them are decided here
    if filters.size_min is not None:
        parts.append(F.col("size") >= filters.size_min if filters.size_min <= _LONG else F.lit(False))
    if filters.size_max is not None and filters.size_max <= _LONG:
        parts.append(F.col("size") <= filters.size_max)
    if filters.modified_after is not None:
        parts.append(F.col("modified") >= moment(filters.modified_after))
    if filters.modified_before is not None:
        parts.append(F.col("modified") <= moment(filters.modified_before))
    return reduce(lambda a, b: a & b, parts)


def excluded(path: Column, patterns: Iterable[str], separator: str = "/") -> Column:
    """True if a component of the path is one of the patterns, in either case; no wildcards."""
    low = [p.lower() for p in patterns]
    return F.exists(F.split(F.lower(path), "\\\\" if separator == "\\" else separator), lambda c: c.isin(low)) if low else F.lit(False)


def glob(value: Column, pattern: str) -> Column:
    """``*``, ``*suffix``, ``prefix*`` or the exact text; case counts."""
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*"):
        return value.endswith(pattern[1:])
    if pattern.endswith("*"):
        return value.startswith(pattern[:-1])
    return value == pattern
