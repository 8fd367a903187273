"""Operators for large training-text pipelines.

Nothing outside this package imports it; ``corpus_pipeline.py`` chains five of
the operators. See the README's section on the training-data operators.
"""
