"""Operators for training-data pipelines: extraction, scans, deduplication, search,
packing, tokenization, classification and language-model scoring over whole tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it."""
