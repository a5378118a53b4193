"""Row-generating extractors over source texts."""
