"""Writers: CSV, text, JSON, replaceable tables."""
