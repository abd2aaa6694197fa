"""Clipwright plans."""
