"""Operators for building language-model training data out of a corpus table.

Nothing outside this folder imports it. Every operator takes and returns DataFrames; the thin
``opN_<name>`` queries over the driver's tables are in :mod:`waymark.llm.queries`.
"""
