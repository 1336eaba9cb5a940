"""Configuration as JSON: missing files give defaults, malformed ones an error."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from trawl.model import ConfigError

# What a scan leaves out and which extensions have searchable content.
EXCLUDED = (".git", "node_modules", "__pycache__", ".DS_Store", "$Recycle.Bin", "System Volume Information")
CONTENT_EXTENSIONS = (
    "txt", "md", "rs", "py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "hpp", "go", "rb", "php",
    "html", "css", "xml", "json", "toml", "yaml", "yml", "ini", "cfg", "conf", "sh", "bat", "ps1", "sql", "log", "csv",
)
CONTENT_MAX_SIZE = 10 * 1024 * 1024


@dataclass
class Config:
    directories: list[dict] = field(default_factory=list)
    excluded_patterns: list[str] = field(default_factory=lambda: list(EXCLUDED))
    default_result_limit: int = 500
    auto_watch: bool = True
    auto_rebuild: bool = True
    index_content: bool = True
    content_max_size: int = CONTENT_MAX_SIZE
    content_extensions: list[str] = field(default_factory=lambda: list(CONTENT_EXTENSIONS))

    @classmethod
    def load(cls, path: str) -> Config:
        if not os.path.exists(path):
            return cls()
        try:
            with open(path) as f:
                return cls(**json.load(f))
        except (ValueError, TypeError) as e:
            raise ConfigError(f"{path}: {e}") from e

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    @classmethod
    def init(cls, path: str) -> Config:
        """Writes the defaults unless there is a file already."""
        if not os.path.exists(path):
            cls().save(path)
        return cls.load(path)

    def roots(self) -> list[str]:
        return [d["path"] for d in self.directories if d.get("enabled", True)]
