"""Plugins: functions of DataFrames that run when rows are indexed and when results are returned."""

from __future__ import annotations

import importlib
import logging
from typing import Protocol

from pyspark.sql import DataFrame

from trawl.model import PluginError, Query

log = logging.getLogger(__name__)


class Plugin(Protocol):
    name: str
    version: str

    def init(self) -> None: ...
    def on_index(self, rows: DataFrame) -> DataFrame: ...
    def on_search(self, query: Query, results: DataFrame) -> DataFrame: ...
    def shutdown(self) -> None: ...


class Registry:
    """Hooks run in the order of registration. Errors while a plan is built are logged and the hook is skipped; errors
    while rows are computed surface at the action, as Spark is lazy."""

    def __init__(self):
        self.plugins: list[Plugin] = []

    def register(self, plugin: Plugin) -> bool:
        try:
            plugin.init()
        except Exception as e:
            log.warning("plugin %s failed to start: %s", plugin.name, e)
            return False
        self.plugins.append(plugin)
        return True

    def load(self, target: str) -> None:
        """Imports module:factory and registers what it makes; a failure is an error."""
        module, _, factory = target.partition(":")
        try:
            plugin = getattr(importlib.import_module(module), factory)()
            plugin.init()
        except Exception as e:
            raise PluginError(f"{target}: {e}") from e
        self.plugins.append(plugin)

    def _each(self, rows: DataFrame, hook) -> DataFrame:
        for plugin in self.plugins:
            try:
                rows = hook(plugin, rows)
            except Exception as e:
                log.error("plugin %s: %s", plugin.name, e)
        return rows

    def on_index(self, rows: DataFrame) -> DataFrame:
        return self._each(rows, lambda p, r: p.on_index(r))

    def on_search(self, query: Query, results: DataFrame) -> DataFrame:
        return self._each(results, lambda p, r: p.on_search(query, r))

    def shutdown(self) -> None:
        for plugin in self.plugins:
            try:
                plugin.shutdown()
            except Exception as e:
                log.error("plugin %s: %s", plugin.name, e)
        self.plugins = []

    def __len__(self) -> int:
        return len(self.plugins)
