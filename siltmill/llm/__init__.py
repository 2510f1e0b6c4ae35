"""Corpus-preparation operators: tokenising, near-duplicates, media, search, filters, packing.

Self-contained: nothing outside this subpackage imports it.
"""
