"""Every query by name: its builder and its DuckDB twin."""

from __future__ import annotations

from clipwright.plans import boxes, cues, dataset, evaluation, files, relations, reports, sequences, texts, vectors
from clipwright.streaming import windows

QUERIES = evaluation.QUERIES | texts.QUERIES | cues.QUERIES | sequences.QUERIES | relations.QUERIES | boxes.QUERIES | dataset.QUERIES | reports.QUERIES | vectors.QUERIES | files.QUERIES | windows.QUERIES
