"""Training-data operators: scoring, deduplication, packing, archives, scans.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
