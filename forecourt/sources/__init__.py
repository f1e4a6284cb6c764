"""Readers: CSV, positional text, charsets, file catalog, result tables."""
