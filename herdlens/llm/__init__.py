"""Operators that prepare text for training language models.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` uses it.
"""
