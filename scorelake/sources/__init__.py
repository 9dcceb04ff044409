"""Readers and writers for document, layout, score and report tables."""
