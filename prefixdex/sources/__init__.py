"""Readers, derived input tables and the versioned frequency-table store."""
