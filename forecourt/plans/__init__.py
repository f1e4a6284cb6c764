"""Whole tasks of the platform, composed from sources, operators and sinks."""
