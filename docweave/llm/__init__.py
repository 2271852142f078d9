"""Operators for building training corpora. Nothing outside this subpackage (and corpus_pipeline.py) imports it."""
