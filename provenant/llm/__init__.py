"""Operators for preparing language-model training data.

Nothing outside this package imports it: the retrieval and document-analytics library stands alone.
"""
