"""Operators for preparing large text corpora for model training.

Nothing outside this package imports it.  ``queries`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
