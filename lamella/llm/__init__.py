"""Operators for preparing training text: deduplication, mixing, cleaning, packing, token and archive files, scoring.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
