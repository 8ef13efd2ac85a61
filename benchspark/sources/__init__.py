"""Readers, writers and file-inventory operators."""
