"""Incremental form of the append logs."""
