"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own interface; ``queries`` registers the thin
``opN_<name>`` queries over the given tables. Nothing outside this subpackage imports it.
"""
