"""Operators of a large-scale training-data pipeline, each in a module of its own.

Nothing outside this subpackage imports it.
"""
