"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`.

Self-contained: nothing else in the library imports this subpackage.
"""
