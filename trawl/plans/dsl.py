"""The query language: keywords and ext: path: size: modified: type: content: terms.

A term that is given twice counts as given last. Quotes only group: the text between them is a term like any other, so
"path:a b" filters while path:"a b" is an empty filter and a keyword.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime, timedelta

from trawl.model import RESULT_LIMIT, EntryType, Filters, ParseError, Query

_TYPES = {"file": EntryType.FILE, "dir": EntryType.DIRECTORY, "directory": EntryType.DIRECTORY, "folder": EntryType.DIRECTORY}
_MOST = (1 << 64) - 1


def tokenize(raw: str) -> list[str]:
    """Terms between spaces and tabs; a quote ends the term before it and begins or ends a quoted one."""
    parts = raw.split('"')
    if len(parts) % 2 == 0:
        raise ParseError("a quote isn't closed")
    out: list[str] = []
    for i, part in enumerate(parts):
        out += [part] if i % 2 else re.split(r"[ \t]+", part)
    return [t for t in out if t]


def _after(term: str, prefix: str) -> str | None:
    """What follows the prefix, whose ASCII letters match in either case."""
    head = term[: len(prefix)]
    return term[len(prefix) :] if head.isascii() and head.lower() == prefix else None


def _number(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > _MOST:
        raise ParseError(f"not a size in bytes: {text!r}")
    return int(text)


def parse_date(text: str) -> datetime:
    """Midnight UTC of year-month-day."""
    if not (m := re.fullmatch(r"([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})", text)):
        raise ParseError(f"not a date like 2024-01-31: {text!r}")
    try:
        return datetime(*map(int, m.groups()))
    except ValueError as e:
        raise ParseError(f"{text!r}: {e}") from e


def _next_day(day: datetime) -> datetime:
    try:
        return day + timedelta(days=1)
    except OverflowError as e:
        raise ParseError(f"no day follows {day:%Y-%m-%d}") from e


def _bounds(value: str, parse, upper):
    """(least, most) of >x, <x and x; all bounds are inclusive."""
    if value.startswith(">"):
        return parse(value[1:]), None
    if value.startswith("<"):
        return None, parse(value[1:])
    return parse(value), upper(parse(value))


def parse(raw: str) -> Query:
    """Blank input matches everything. Raises ParseError."""
    raw = raw.strip()
    query, filters, keywords = Query(raw=raw), Filters(), []
    for term in tokenize(raw):
        if (v := _after(term, "ext:")) is not None:
            filters = replace(filters, extension=v.lower().lstrip("."))
        elif (v := _after(term, "path:")) is not None:
            filters = replace(filters, path_contains=v)
        elif (v := _after(term, "size:")) is not None:
            low, high = _bounds(v, _number, lambda n: n)
            filters = replace(filters, **{k: x for k, x in (("size_min", low), ("size_max", high)) if x is not None})
        elif (v := _after(term, "modified:")) is not None:
            low, high = _bounds(v, parse_date, _next_day)
            filters = replace(filters, **{k: x for k, x in (("modified_after", low), ("modified_before", high)) if x is not None})
        elif (v := _after(term, "type:")) is not None:
            if v.lower() not in _TYPES:
                raise ParseError(f"unknown type {v!r}: file or dir")
            filters = replace(filters, entry_type=_TYPES[v.lower()])
        elif _after(term, "content:") is not None:
            query = replace(query, search_content=True)
        else:
            keywords.append(term.lower())
    return replace(query, filters=filters, keywords=tuple(keywords))


def normalise(query: Query) -> Query:
    """Trimmed lower-case keywords without empty ones, and the result limit."""
    return replace(query, keywords=tuple(k for k in (x.strip().lower() for x in query.keywords) if k), limit=RESULT_LIMIT)
