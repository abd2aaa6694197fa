"""Clipwright operators."""
