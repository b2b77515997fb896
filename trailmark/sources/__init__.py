"""Readers of recorded tables and JSON side files, and writers of results."""
