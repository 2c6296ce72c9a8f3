"""Plan-level helpers: lineage cuts and shared session settings."""
