"""The catalog's schema, query records, enumerations and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum

#: One row a file or directory. Times are UTC without a zone, so results don't depend on the session's.
CATALOG = "id long, name string, path string, extension string, size long, modified timestamp_ntz, is_dir boolean, content_hash string"
#: Parent-pointer records of a volume's file table; file_time counts 100 ns since 1601, seq is the place in the table.
RECORDS = "file_ref long, parent_ref long, name string, is_dir boolean, file_time long, seq long"
CHANGES = "event string, path string, origin string, at timestamp_ntz, seq long"
RESULT_LIMIT = 500


class EntryType(Enum):
    FILE = "file"
    DIRECTORY = "directory"


class SortField(Enum):
    RELEVANCE = "relevance"
    NAME = "name"
    PATH = "path"
    SIZE = "size"
    MODIFIED = "modified"


class SortOrder(Enum):
    ASCENDING = "asc"
    DESCENDING = "desc"


@dataclass(frozen=True)
class Filters:
    extension: str | None = None
    path_contains: str | None = None
    size_min: int | None = None
    size_max: int | None = None
    modified_after: datetime | None = None
    modified_before: datetime | None = None
    entry_type: EntryType | None = None


@dataclass(frozen=True)
class Query:
    raw: str = ""
    keywords: tuple[str, ...] = ()
    filters: Filters = field(default_factory=Filters)
    limit: int | None = None
    sort_by: SortField = SortField.RELEVANCE
    sort_order: SortOrder = SortOrder.DESCENDING
    search_content: bool = False


class TrawlError(Exception):
    """Base of all errors of the engine."""


class ConfigError(TrawlError): ...


class IndexStorageError(TrawlError): ...


class ScanError(TrawlError): ...


class SearchError(TrawlError): ...


class ParseError(TrawlError): ...


class WatchError(TrawlError): ...


class PlatformError(TrawlError): ...


class PluginError(TrawlError): ...


class ContentError(TrawlError): ...
