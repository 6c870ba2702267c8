"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Every operator takes and returns DataFrames; ``queries`` binds them to the
corpus tables.
"""
