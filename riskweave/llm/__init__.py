"""Operators for large text-corpus preparation: mixing, packing, token files, search, dedup, filters.

Nothing else in the library imports this subpackage. Every operator selects the columns it needs by
name first, so other columns of its input are ignored, whatever they are called.
"""
