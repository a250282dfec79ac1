"""Operators of a training-data pipeline: deduplication, scans, search, packing, formatting, scoring and mixing.

Nothing outside this package imports it.  ``queries`` registers one query for each operator, ``sql`` their SQL twins.
"""
