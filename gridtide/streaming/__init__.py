"""Incremental intake of landing files."""
