"""Part of the file-catalog search engine."""
