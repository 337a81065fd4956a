"""Training-data operators: sharding, scans, decontamination, dedup, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as
part of it) imports it, so it can be removed without touching the rest.
"""
