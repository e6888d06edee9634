"""Operators of a training-data pipeline: cleaning, scoring, de-duplication, search,
tokenisation, mixing and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
