"""Spark operators over positioned document data (words, cells, lines, fields, templates)."""
