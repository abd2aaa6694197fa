"""Clipwright sources."""
