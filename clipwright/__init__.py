"""Clipwright: DataFrame-first analytics over labelled multimodal clip data."""
