"""Readers of tables and the versioned index store."""
