"""Structured Streaming over files dropped into a landing folder."""
