"""Operators for large text corpora: media columns, scans, codecs, sharding, scoring and deduplication.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
