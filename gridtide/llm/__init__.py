"""Operators of a text corpus pipeline: archives, filters, fingerprints, duplicates, mixing and packing."""
