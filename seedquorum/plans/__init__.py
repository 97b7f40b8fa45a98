"""Plan-level helpers: shared working folder, written intermediate tables, named queries."""
