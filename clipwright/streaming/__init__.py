"""Clipwright streaming."""
