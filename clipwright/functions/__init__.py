"""Clipwright functions."""
