"""Query syntax trees, their parsers, validation and compilation to columns."""
