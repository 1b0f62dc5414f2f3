"""Operators for training corpora: deduplication, secrets, sharding, extraction,
archives, media, quality, search, packing and tokenization.

Nothing outside this subpackage (but the top-level ``corpus_pipeline.py``) imports it.
"""
