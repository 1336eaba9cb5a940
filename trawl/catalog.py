"""The service: a stored catalog with its configuration, scans, changes and searches."""

from __future__ import annotations

import logging
import os
import threading
from collections import OrderedDict, deque
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession

from trawl.config import Config
from trawl.model import CATALOG, ConfigError, Query, ScanError
from trawl.operators import catalog_ops, search
from trawl.plans import dsl
from trawl.plugins import Registry
from trawl.scratch import materialise
from trawl.sources import files, storage

log = logging.getLogger(__name__)
#: Searches that a catalog remembers.
CACHED = 128


class Catalog:
    """One folder holds config.json and the index; one rebuild or scan runs at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.index, self.config_path = os.path.join(folder, "index"), os.path.join(folder, "config.json")
        self.config, self.plugins = Config.load(self.config_path), Registry()
        self.tasks: deque = deque()
        self._busy = threading.Lock()
        self._rows: DataFrame | None = None
        #: Entries indexed, skipped and in error in the last scan, and a function that is told of steps.
        self.last_scan: dict[str, int] = {}
        self.on_progress = lambda phase, done, message: log.info("%s: %s", phase, message)
        self._cache: OrderedDict = OrderedDict()

    def _scanned(self, phase: str, roots: list[str], first: int, use) -> DataFrame:
        """Scans, passes the rows on to ``use`` and reports."""
        self.on_progress(phase, False, f"scanning {len(roots)} directories")
        counters = Observation()
        try:
            rows = files.scan_roots(self.spark, roots, self.config.excluded_patterns, first, counters)
            use(rows)
        except Exception as e:
            self.on_progress(phase, True, f"failed: {e}")
            raise
        self.last_scan = counters.get if any(os.path.isdir(r) for r in roots) else {}
        self.on_progress(phase, True, f"done: {self.last_scan}")
        return self.stats()

    def open(self) -> DataFrame:
        """The stored rows; an empty catalog where nothing is stored."""
        if self._rows is None:
            self._rows = storage.load(self.spark, self.index) if storage.exists(self.index) else self.spark.createDataFrame([], CATALOG)
        return self._rows

    def save(self, rows: DataFrame) -> dict:
        out = storage.save(self.plugins.on_index(rows), self.index)
        self._rows = None
        self._cache.clear()
        return out

    def rebuild(self) -> DataFrame:
        """Scans all enabled directories anew; without any the catalog stays as it is."""
        with self._busy:
            roots = self.config.roots()
            if not roots:
                log.warning("no directory is enabled")
            else:
                return self._scanned("rebuild", roots, 1, self.save)
        return self.stats()

    def index_all_volumes(self) -> DataFrame:
        """Scans all volumes and makes them the configured directories."""
        points = [r["mount_point"] for r in files.volumes(self.spark).collect()]
        self.config.directories = [{"path": p, "enabled": True} for p in points]
        self.config.save(self.config_path)
        return self.rebuild()

    def upsert_scan(self, root: str) -> DataFrame:
        """Puts a directory's rows in by path; rows of vanished files stay."""
        if not os.path.isdir(root):
            raise ScanError(f"{root} is no directory")
        with self._busy:
            first = storage.meta(self.index)["next_id"] if storage.exists(self.index) else 1
            return self._scanned("scan", [root], first, lambda rows: self.save(catalog_ops.upsert(self.open().select(*rows.columns), rows)))

    def search(self, raw: str | Query, as_of: datetime | None = None, limit: int | None = None) -> DataFrame:
        """Results in their order. A search with its own as_of is kept, with scores and snippets, until rows change."""
        key = (raw, as_of, limit, self.config.index_content) if as_of else None
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        query = dsl.normalise(dsl.parse(raw) if isinstance(raw, str) else raw)
        rows = self.open()
        as_of = as_of or datetime.now(UTC).replace(tzinfo=None)
        out = search.ranked(search.matches(rows, query), query, as_of)
        if limit is not None:
            out = search.limited(out, limit)
        if query.search_content and self.config.index_content and query.keywords:
            # at most a result's limit of rows, written so that the search runs once
            out = materialise(out, "results")
            found = files.contents(out, self.config.content_extensions, self.config.content_max_size)
            out = search.with_snippets(out, found, query.keywords).orderBy(*search.order_of(query))
        out = self.plugins.on_search(query, out)
        if key:
            self._cache[key] = out
            while len(self._cache) > CACHED:
                self._cache.popitem(last=False)
        return out

    def stats(self) -> DataFrame:
        return catalog_ops.index_stats(self.open())

    def add_directory(self, path: str) -> None:
        if not os.path.isdir(path):
            raise ConfigError(f"{path} is no directory")
        if any(d["path"] == path for d in self.config.directories):
            raise ConfigError(f"{path} is configured already")
        self.config.directories.append({"path": path, "enabled": True})
        self.config.save(self.config_path)

    def remove_directory(self, path: str) -> None:
        """Its rows stay in the catalog."""
        self.config.directories = [d for d in self.config.directories if d["path"] != path]
        self.config.save(self.config_path)

    def update_config(self, config: Config) -> None:
        self.config = config
        config.save(self.config_path)

    def run_tasks(self) -> int:
        """Runs queued functions first in, first out."""
        n = 0
        while self.tasks:
            self.tasks.popleft()()
            n += 1
        return n
